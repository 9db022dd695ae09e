"""Quality rules, decontamination, line dedup, language ID and toxicity against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, linededup, quality, shared, textnum

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Größe", "naïve", "x1", "日本", "a_b", "C#", "end."] + [f"w{k}" for k in range(60)]
    made = [None, "", " ", "\n", "\n\n \t\n", "one", "a\x0bb\x0cc", "é" * 50, "same line\nsame line\nSame line", "x " * 300, "\U0001f600 ok"]
    for _ in range(60):
        made.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", ", ", " "]) for _ in range(rng.randrange(1, 150))))
    made += [made[20], made[20], made[30] + " " + made[31], " ".join(["loop of some words that come back again and again"] * 9)]
    return made


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words long")


def repeats(words, n=8):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            hit |= set(range(i, i + n))
    return len(hit)


def test_words_and_windows_of_many_texts():
    texts = ["a b", "", "b c d", "d"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t) for t in texts]])
    starts, ends, counts = textnum.words(np.frombuffer(raw, np.uint8), offsets, textnum.SPACED)
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["a", "b", "b", "c", "d", "d"] and list(counts) == [0, 2, 2, 5, 6]
    assert list(textnum.whole(counts, 2)) == [True, False, True, True, False]
    h = textnum.word_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    assert h[1] == h[2] and h[4] == h[5] and h[0] != h[1]


def test_quality_counts(spark, texts):
    got = {r.doc_id: r for r in quality.quality_columns(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(words))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, k
        assert r.base_failed == (len(words) < 20 or 100 * want[4] > 30 * len(words))
        assert not (r.kept and r.base_failed)


def test_quality_bands(spark):
    import base64

    rng = random.Random(1)
    noise = base64.b85encode(rng.randbytes(6000)).decode()
    fair = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randrange(1, 5))) for _ in range(900))
    rows = [(0, fair), (1, " ".join(noise[i : i + 30] for i in range(0, len(noise), 30))), (2, "abc def " + "ghi jkl " * 2000), (3, None)]
    got = {r.doc_id: r.kept for r in quality.quality_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"] and [r.doc_id for r in kept.collect()] == [0]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_learned_bands_against_brute_force(spark):
    import zstandard

    rng = random.Random(8)
    good = [prose(rng, int(2 ** rng.uniform(5, 9))) for _ in range(400)]
    bands = quality.fit_bands(spark.createDataFrame([(t,) for t in good + [None, ""]], "text string"))
    assert len(bands.knots) > 3 and all(a < b for a, b in zip(bands.low, bands.high))
    decorated = [" ".join(w + "***" for w in prose(rng, n).split()) for n in (60, 120, 300)]
    fresh = [prose(rng, n) for n in (60, 120, 300)]
    texts = fresh + decorated + [prose(rng, 4000), prose(rng, 900) + " " + "ab " * 9000, "é" * 40, None, prose(rng, 60_000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, _quality int")
    got = {r.doc_id: r for r in quality.quality_columns(docs, bands=bands, base=quality.Base(0, 8, 1.0)).collect()}
    z = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

    def fits(b):
        low, high = (float(x[0]) for x in bands.limits(np.array([len(b)])))
        return low <= len(b) / len(z.compress(b)) <= high * (1 + bands.wide[0] * max(0, len(b) / len(b.decode("utf-8", "replace")) - bands.wide[1]))

    for k, t in enumerate(texts):
        b = (t or "").encode()
        chunks = [c for i in range(0, len(b), bands.chunk_bytes) if len(c := b[i : i + bands.chunk_bytes]) >= quality.LEAST_CHUNK] if len(b) > bands.chunk_bytes else []
        odd = sum(not fits(c) for c in chunks)
        assert (got[k].n_chunks, got[k].n_odd_chunks) == (len(chunks), odd), k
        assert got[k].kept == ((fits(b) if b else True) and (odd < 2 or odd <= bands.odd_share * len(chunks))), k
    assert all(got[k].kept for k in range(3)) and not any(got[k].kept for k in range(3, 6)) and not got[7].kept
    kept = quality.keep_good(docs, bands=bands, base=quality.Base(0, 8, 1.0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality.quality_columns(docs.limit(0)).count() == 0


HINDI = """भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं और हर प्रदेश की अपनी अलग संस्कृति दिखाई देती है। उत्तर में हिमालय की ऊँची चोटियाँ बर्फ से ढकी रहती हैं, जबकि दक्षिण के समुद्र तटों पर नारियल के पेड़ हवा में झूमते हैं। गाँवों में किसान सुबह जल्दी उठकर खेतों की ओर निकल पड़ते हैं और शाम तक मेहनत करते हैं। शहरों की सड़कों पर गाड़ियों का शोर सुनाई देता है, लोग दफ्तर पहुँचने की जल्दी में रहते हैं। बच्चों को विद्यालय भेजने के बाद माताएँ घर के काम निपटाती हैं। पिछले कुछ वर्षों में तकनीक ने जीवन को बहुत बदल दिया है; अब छोटे दुकानदार भी मोबाइल से भुगतान स्वीकार करते हैं। मेरे दादाजी कहा करते थे कि पढ़ाई का कोई विकल्प नहीं होता, इसलिए उन्होंने अपनी ज़मीन बेचकर हमें पढ़ाया। त्योहारों के समय पूरा मोहल्ला रोशनी से जगमगा उठता है और मिठाइयों की खुशबू चारों ओर फैल जाती है। बरसात में नदियाँ उफान पर होती हैं तो पुल पार करना कठिन हो जाता है। वैज्ञानिकों का मानना है कि जलवायु परिवर्तन के कारण मौसम का चक्र अनियमित हुआ है। एक पुरानी लोककथा के अनुसार राजा ने अपने तीनों पुत्रों की परीक्षा लेने के लिए उन्हें जंगल भेजा था। सबसे छोटा राजकुमार एक घायल पक्षी की सेवा में रुक गया और उसी दया के कारण उसे राजगद्दी मिली।"""
#: First letter, number of letters, signs that follow a letter.
SCRIPTS = {"hi": (0x915, 35, "ािीुूेैोौं्"), "ta": (0xB95, 30, "ாிீுூெேைொோ்"), "th": (0xE01, 40, "ะาิีึืุู่้"), "ru": (0x430, 32, ""), "el": (0x3B1, 25, "")}


def prose_of(script, n_bytes, seed=0):
    """Words of a script, drawn from a vocabulary as uneven as that of prose."""
    first, n, signs = SCRIPTS[script]
    rng = random.Random(f"{script}{seed}")
    letters = [chr(c) for c in range(first, first + n) if chr(c).isalpha()]
    often = [1 / (k + 3) for k in range(len(letters))]
    part = lambda: rng.choices(letters, often)[0] + (rng.choice(signs) if signs and rng.random() < 0.6 else "")
    words = ["".join(part() for _ in range(rng.randrange(1, 3) + min(k // 40, rng.randrange(0, 4)))) for k in range(8000)]
    text = " ".join(rng.choices(words, [1 / (k + 3) for k in range(len(words))], k=n_bytes // 3))
    return text.encode()[:n_bytes].decode("utf-8", "ignore")


@pytest.mark.parametrize("script", SCRIPTS)
def test_clean_texts_of_any_script_fit_the_bands(spark, script):
    sizes = [512, 1500, 2100, 4300, 8500, 17000, 40000, 65000, 66000]
    texts = [prose_of(script, n) for n in sizes] + ([HINDI, HINDI[:820]] if script == "hi" else [])
    twice = [prose_of(script, n // 2, 1) + " " + prose_of(script, n // 2, 1) for n in sizes[2:6]]
    rows = list(enumerate(texts + [" ".join([HINDI[:90]] * 40)] + twice))
    got = {r.doc_id: r for r in quality.quality_columns(spark.createDataFrame(rows, "doc_id long, text string"), base=quality.Base(repeat_share=1.0)).collect()}
    assert [(k, got[k].zstd_ratio) for k in range(len(texts)) if not got[k].kept] == []
    assert [(k, got[k].zstd_ratio) for k in range(len(texts), len(rows)) if got[k].kept] == []


def brute_hits(texts, items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(n, len(w))]), set()).add(str(i))
    out = {}
    for k, t in enumerate(texts):
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if own := windows.get(tuple(w[j : j + size])):
                    hit |= set(range(j, j + size))
                    found |= own
        out[k] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_contamination(spark, texts, block_words):
    items = [(1, " ".join(ALNUM.findall(texts[15])[3:20])), (2, "one"), (3, None), (4, "!!"), (5, texts[25]), (6, texts[25]), (None, "日本 x1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, [("" if i is None else i, t) for i, t in items])
    got = decontaminate.contamination(frame(spark, texts), bench, block_words=block_words).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert any(v[1] for v in want.values()) and any(not v[1] for v in want.values())


def test_contamination_of_empty_tables_long_texts_and_clashing_names(spark):
    words = " ".join(f"w{k}" for k in range(50_000))
    docs = spark.createDataFrame([(1, words, 7, 8, 9), (2, None, 7, 8, 9), (1, words, 7, 8, 9)], "doc_id long, text string, _b0 int, n_hit int, _made int")
    bench = spark.createDataFrame([(1, "w5 w6 w7"), (2, "w40000")], "item_id long, text string")
    for block_words in (1000, 1):
        got = decontaminate.contamination(docs, bench, block_words=block_words).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r._b0, r._made) for r in got) == [(1, 50_000, 4, 7, 9)] * 2 + [(2, 0, 0, 7, 9)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [0, 0, 0]


def test_spans_are_cut_out(spark):
    passage = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, f"Größe über alles hier und dort noch mehr Worte dazu, ja viele! {passage}. end of it"), (2, passage), (3, "clean"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()}
    assert out == {1: "Größe über alles hier und dort noch mehr Worte dazu, ja viele!  . end of it", 3: "clean", 4: None}


def brute_lines(texts, least):
    keys = [{low(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n")} - {""} for t in texts]
    n = Counter(k for s in keys for k in s)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[low(x.strip(" \t\n\r\x0b\x0c"))] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("broadcast_keys", "hot_share"), [(1000, 1), (1, 1), (1, 20)])
def test_line_dedup(spark, texts, broadcast_keys, hot_share):
    rows = [*texts, *[f"Common Line \n own {k}" for k in range(5)], *["twice\ntwice"] * 2, "line\n" * 20_000]
    docs = frame(spark, rows).withColumns({"_made": F.lit(1), "_key": F.lit(2), "_found": F.lit(3), "N_Lines": F.lit(4)})
    runs = linededup.LineRuns(spark, least_docs=3, fanout=2)
    for k in range(3):
        assert runs.add(docs.filter(F.col("doc_id") % 3 == k), batch_id=str(k))
    assert not runs.add(docs, batch_id="1") and max(runs.levels) >= 1
    got = {r.doc_id: r for r in linededup.drop(docs, runs.frequent(), broadcast_keys=broadcast_keys, hot_share=hot_share).collect()}
    assert {k: (r.n_lines, r.n_dropped, r.kept_text) for k, r in got.items()} == dict(enumerate(brute_lines(rows, 3)))
    assert all((r._made, r._key, r._found) == (1, 2, 3) for r in got.values())
    assert runs.novel(docs).count() == 0
    assert runs.novel(spark.createDataFrame([(1, "quite new\ncommon line")], "doc_id long, text string")).count() == 1


def test_line_runs_are_found_again_and_only_batches_are_shuffled(spark):
    docs = lambda *t: spark.createDataFrame([*enumerate(t)], "doc_id long, text string")
    first = linededup.LineRuns(spark, least_docs=2, fanout=2)
    first.add(docs("a\nb", "c"), batch_id="x")
    late = linededup.LineRuns(spark, first.folder, least_docs=2, fanout=2)
    first.add(docs("b"), batch_id="y")
    with pytest.raises(RuntimeError):
        late.add(docs("c"), batch_id="z")
    again = linededup.LineRuns(spark, first.folder, least_docs=2, fanout=2)  # after a compaction
    assert again.levels == [1] and not again.add(docs("a"), batch_id="y")
    for k, t in enumerate(("b", "a\nb", "d", "c")):
        again.add(docs(t), batch_id=str(k))
    assert again.frequent().count() == 3 and again.novel(docs("d\ne")).count() == 1
    assert again.frequent().select("a", "b").distinct().count() == 3  # each key ripens once
    plan = again.novel(docs("d\ne"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == len(again.levels)  # of the batch alone
    with pytest.raises(ValueError):
        linededup.LineRuns(spark, first.folder, least_docs=5)


def test_line_dedup_of_an_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_id(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "and", "with"], "de": ["der", "ung", "sch", "ein", "ß"], "fr": ["eau", "ç", "que", "le", "é"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(20)), lang) for k, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "der eine", None), (None, "the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = shared.crc32_fold(F.col("doc_id"), 4)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs.filter(fold != 2))).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows[:90])
    assert [got[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"] and got[900].score == 0
    none = langid.predict(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_trigrams_stay_in_their_text():
    data = "ab!c".encode()
    grams, edges = langid.trigrams(np.frombuffer(data, np.uint8), np.array([0, 2, 3, 4]), 1 << 15)
    assert list(edges) == [0, 2, 2, 3]  # " ab", "ab ", nothing, " c "


def test_crc32_fold(spark):
    import zlib

    rows = spark.range(50).select("id", shared.crc32_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_labels_join_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    for most in (100, 0):
        monkeypatch.setattr(shared, "BROADCAST_LABELS", most)
        assert [(r.doc_id, r.toxic) for r in shared.with_label(docs, labels, "toxic").collect()] == [(1, 1)]


def test_sha_of_kept_text_is_of_utf8(spark):
    out = linededup.dedup(spark.createDataFrame([(1, "é")], "doc_id long, text string")).select(F.sha2("kept_text", 256)).first()[0]
    assert out == hashlib.sha256("é".encode()).hexdigest()
