"""Chat formatting, mixing, token counts, HTML extraction and the pipeline."""

import hashlib
import html
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chatformat, htmlmain, htmltree, mixing, tokencounts

NASTY = ["\\### Assistant: </turn> ok", "<|end|>\n", "<|turn|>assistant<|says|>x", "\\<|", "<\\|end|>", "a\\", "<", "|end|>", "", None, "line\nline", "é\U0001f600"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<|says|>", None]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(100, 0, "user", "only"), (101, None, "assistant", "no turn"), (101, 1, "assistant", "no turn"), (None, 0, "assistant", "no conversation")]
    made = chatformat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chatformat.digest(made).collect()}
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    for r in made.collect():
        reply = [x for x in r.formatted[r.loss_start : r.loss_start + r.loss_chars]]
        assert r.trainable or not reply
    trainable = sum(1 for turns in talks.values() for _, r, _ in turns if r == "assistant")
    assert made.filter("trainable").count() == trainable
    assert chatformat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_formatting_runs_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chatformat.digest(chatformat.examples(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def mixing_rows():
    rng = random.Random(2)
    plain, bad = [f"good{k}" for k in range(50)], [f"bad{k}" for k in range(10)]
    rows = []
    for k in range(300):
        toxic = k % 3 == 0
        rows.append((k, " ".join(rng.choice(bad if toxic and rng.random() < 0.5 else plain) for _ in range(rng.randrange(5, 40))), int(toxic)))
    return rows


def test_mixing_meets_its_targets(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame([(k, t, 7) for k, t, _ in rows] + [(1000, None, 7), (1001, "", 7)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 2], "doc_id long, domain int")
    got = mixing.mix(docs, labels, {"good": 0.85, "toxic": 0.15}).collect()
    assert len(got) == 302 and all(r.rate >= 0 and abs(r.p_good + r.p_toxic - 1) < 1e-9 for r in got)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.rate * r.n_tokens * r.p_toxic for r in got) / total - 0.15) < 2e-3
    assert abs(sum(r.rate * r.n_tokens * r.p_good for r in got) / total - 0.85) < 2e-3
    assert all(np.floor(r.rate) <= r.n_copies <= np.floor(r.rate) + 1 for r in got)
    right = [(r.p_toxic > 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id < 300]
    assert np.mean(right) > 0.95


def test_rates_are_the_least_squares_fit(spark):
    cells = spark.createDataFrame([(1.0, 0.0, 70), (0.0, 1.0, 20), (0.5, 0.5, 10)], "p_a double, p_b double, tokens long")
    rated, ended = mixing.fit_rates(cells, ["a", "b"], [0.5, 0.5])
    got = rated.collect()
    shares = [sum(r.rate * r.tokens * r[f"p_{k}"] for r in got) / 100 for k in "ab"]
    assert np.allclose(shares, [0.5, 0.5], atol=1e-3) and all(r.rate >= 0 for r in got) and ended.met and ended.gap < 1e-3
    unreachable, ended = mixing.fit_rates(spark.createDataFrame([(1.0, 0.0, 100)], "p_a double, p_b double, tokens long"), ["a", "b"], [0.5, 0.5])
    assert abs(unreachable.first().rate - 0.5) < 2e-3 and not ended.met and abs(ended.gap - 0.5) < 2e-3


def test_rates_of_zero_where_targets_ask_for_less_than_none(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.dirichlet([60, 0.5, 0.5], 150), rng.dirichlet([0.5, 10, 1], 30), rng.dirichlet([0.5, 0.5, 10], 20)])
    tokens = rng.integers(1, 500, 200)
    want = np.array([0.65, 0.015, 0.335])
    cells = spark.createDataFrame([(*map(float, x), int(n)) for x, n in zip(p, tokens)], "p_a double, p_b double, p_c double, tokens long")
    rated, ended = mixing.fit_rates(cells, ["a", "b", "c"], list(want))
    got = {(r.p_a, r.p_b): r.rate for r in rated.collect()}
    rate = np.array([got[x[0], x[1]] for x in p])
    assert (rate == 0).sum() > 10 and rate.max() > 3 and ended.settled
    # against plain projected gradient in memory
    n = tokens / tokens.sum()
    w = np.linalg.inv((p * n[:, None]).T @ p)
    r = np.ones(200)
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (w @ ((r * n) @ p - want)))
    loss = lambda x: float(((x * n) @ p - want) @ w @ ((x * n) @ p - want))
    assert abs(loss(rate) - loss(r)) < 1e-4 and ended.met and ended.gap < mixing.MET


def test_rates_towards_targets_that_few_cells_can_meet(spark):
    # nearly all good cells hold 2 % of poor, and the target is half of that
    cells = spark.createDataFrame([(0.98, 0.02, 0.0, 700), (1.0, 0.0, 0.0, 20), (0.1, 0.9, 0.0, 120), (0.0, 0.02, 0.98, 140), (0.0, 0.0, 1.0, 20)], "p_a double, p_b double, p_c double, tokens long")
    rated, ended = mixing.fit_rates(cells, ["a", "b", "c"], [0.65, 0.01, 0.34])
    got = {r.p_a: r.rate for r in rated.filter("p_a > 0").collect()}
    assert ended.met and ended.steps < 40 and got[0.1] == 0 and got[1.0] > got[0.98]


def test_thinning_never_drops_what_is_mostly_good(spark):
    rows = [(0.97, 0.03, 0.0, 600), (0.93, 0.05, 0.02, 150), (0.1, 0.9, 0.0, 120), (0.05, 0.0, 0.95, 130)]
    cells = spark.createDataFrame(rows, "p_good double, p_poor double, p_toxic double, tokens long")
    want = mixing.thinned(cells, {"good": 0.92, "poor": 0.02, "toxic": 0.06}, ("poor", "toxic"))
    assert abs(want["poor"] - (600 * 0.03 + 150 * 0.05) / 750) < 1e-9 and want["toxic"] == 0.06 and abs(sum(want.values()) - 1) < 1e-9
    rates = {r.p_good: r.rate for r in mixing.fit_rates(cells, list(want), list(want.values()))[0].collect()}
    assert rates[0.97] >= 1 and rates[0.93] >= 1 and rates[0.1] < 0.2 and rates[0.05] < 1
    clean = spark.createDataFrame([r for r in rows if r[0] > 0.9], cells.schema)
    same = mixing.thinned(clean, {"good": 0.92, "poor": 0.02, "toxic": 0.06}, ("poor", "toxic"))
    assert all(abs(r.rate - 1) < 0.02 for r in mixing.fit_rates(clean, list(same), list(same.values()))[0].collect())


def test_posteriors_against_brute_force(spark):
    rows = mixing_rows()
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, domain int")
    odds = mixing.fit(labelled, 2)
    word = {r.w: r.b for r in spark.createDataFrame([(w,) for w in {w for _, t, _ in rows for w in t.split()}], "w string").select("w", mixing.buckets(F.col("w"))[0].alias("b")).collect()}
    counts = np.zeros((2, mixing.BUCKETS + len(mixing.SYMBOLS)))
    for _, t, y in rows:
        for w in t.split():
            counts[y, word[w]] += 1
        for k, c in enumerate(mixing.SYMBOLS):
            counts[y, mixing.BUCKETS + k] += t.count(c)
    pooled = counts.sum(axis=0) + 0.5
    logs = np.log(0.5 * counts / counts.sum(axis=1, keepdims=True) + 0.5 * pooled / pooled.sum())
    want = np.where(np.abs(logs[1] - logs[0]) < mixing.LEAST_ODDS, 0, logs[1] - logs[0])
    assert np.allclose(odds[1], want)
    got = mixing._evidence(spark.createDataFrame([(k, t) for k, t, _ in rows[:40]], "k int, text string"), odds, "text").collect()
    for r in got:
        ids = [word[w] for w in rows[r.k][1].split()]
        assert r.n_tokens == len(ids) and abs(r._x1 - odds[1][ids].sum() / len(ids) ** 0.5) < 1e-2


@pytest.mark.parametrize("n_toxic", [0, 9, 60])
def test_the_pipeline_only_thins_toxic_documents(spark, folder, n_toxic):
    import corpus_pipeline

    rng = random.Random(4)
    plain, bad = [f"good{k}" for k in range(50)], [f"bad{k}" for k in range(10)]
    rows = [(k, " ".join(rng.choice(bad if k < n_toxic and j % 2 else plain) for j in range(40))) for k in range(300)]
    spark.createDataFrame([(k, 1, int(k < n_toxic)) for k, _ in rows if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()}
    assert all(k in got and got[k].rate >= 1 for k in range(n_toxic, 300))
    toxic = sum(got[k].n_copies for k in range(n_toxic) if k in got)
    assert toxic == n_toxic if n_toxic < 0.06 * 300 else toxic < 0.5 * n_toxic


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain int")
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert mixing.mix(docs, none, {"good": 0.5, "toxic": 0.5}).count() == 2
    assert mixing.mix(docs.limit(0), none, {"good": 0.5, "toxic": 0.5}).count() == 0


def totals_of(store):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_token_deltas(spark, folder):
    encode = tokencounts._encoding(tokencounts.TOKENIZER).encode_ordinary
    schema = "doc_id long, text string, source string, lang string"
    first = [(1, "hello world", "a", "en"), (2, "über Größe", "a", "de"), (3, None, "b", None), (4, "hello world", "a", "en"), (4, "hello world", "a", "en"), (None, "no id", "a", "en")]
    store = tokencounts.TokenTotals(spark, folder)
    assert store.totals().count() == 0
    assert store.commit("1", inserts=spark.createDataFrame(first, schema))
    n = lambda t: len(encode(t))
    want = {("a", "en"): (4, 3 * n("hello world") + n("no id")), ("a", "de"): (1, n("über Größe")), ("b", None): (1, 0)}
    assert totals_of(store) == want
    again = tokencounts.TokenTotals(spark, folder)
    assert not again.commit("1", inserts=spark.createDataFrame(first, schema)) and totals_of(again) == want
    store.commit("2", deletes=spark.createDataFrame([(4,), (77,), (None,)], "doc_id long"))
    store.commit("3", revised=spark.createDataFrame([(2, "kürzer", "a", "de")], schema), inserts=spark.createDataFrame([(5, "x", "b", "en")], schema))
    store.commit("4", deletes=spark.createDataFrame([(5,)], "doc_id long"))
    store.commit("5", deletes=spark.createDataFrame([(5,)], "doc_id long"))
    assert totals_of(store) == {("a", "en"): (2, n("hello world") + n("no id")), ("a", "de"): (1, n("kürzer")), ("b", None): (1, 0)}


SCHEMA = "doc_id long, text string, source string, lang string"


def test_an_id_deleted_and_revised_in_one_batch_is_taken_back_once(spark, folder):
    store = tokencounts.TokenTotals(spark, folder)
    docs = spark.createDataFrame([(1, "hello", "a", "en"), (2, "world", "a", "en")], SCHEMA)
    store.commit("1", inserts=docs)
    store.commit("2", deletes=docs.select("doc_id").filter("doc_id = 1"), revised=docs.filter("doc_id = 1"))
    assert totals_of(store) == {("a", "en"): (2, 2)}


def test_of_two_writers_of_a_batch_one_wins(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(1, "hello", "a", "en")], SCHEMA)
    one, two = tokencounts.TokenTotals(spark, folder), tokencounts.TokenTotals(spark, folder)
    write = one._written

    def late(rows):
        made = write(rows)
        monkeypatch.setattr(one, "_written", write)
        assert two.commit("1", inserts=docs)  # the other comes first, after both found the batch missing
        return made

    monkeypatch.setattr(one, "_written", late)
    assert not one.commit("1", inserts=docs) and totals_of(two) == {("a", "en"): (1, 1)}


def test_an_overtaken_writer_sees_what_the_other_took_back(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(1, "hello", "a", "en"), (2, "x", "a", "en")], SCHEMA)
    one, two = tokencounts.TokenTotals(spark, folder), tokencounts.TokenTotals(spark, folder)
    one.commit("1", inserts=docs)
    ids, write = docs.select("doc_id").filter("doc_id = 1"), one._written

    def late(rows):
        made = write(rows)
        monkeypatch.setattr(one, "_written", write)
        two.commit("2", deletes=ids)
        return made

    monkeypatch.setattr(one, "_written", late)
    assert one.commit("3", deletes=ids) and totals_of(one) == {("a", "en"): (1, 1)}


def test_versions_and_compaction(spark, folder):
    docs = spark.createDataFrame([(1, "hello", "a", "en"), (2, "x y", "a", "en"), (None, "z", "a", "en")], SCHEMA).withColumns({"part": F.lit(9), "tokens": F.lit("x")})
    old, new = tokencounts.TokenTotals(spark, folder, version="v1"), tokencounts.TokenTotals(spark, folder, version="v2")
    assert old.commit("1", inserts=docs) and new.commit("1", inserts=docs)
    old.commit("2", deletes=docs.select("doc_id").filter("doc_id = 1"))
    want = {(r.tokenizer): (r.n_docs, r.n_tokens) for r in old.totals().collect()}
    assert want == {"v1": (2, 3), "v2": (3, 4)}
    old.compact()
    assert {(r.tokenizer): (r.n_docs, r.n_tokens) for r in old.totals().collect()} == want and not old.commit("2", inserts=docs)
    old.commit("3", deletes=docs.select("doc_id"))
    assert {(r.tokenizer): r.n_docs for r in new.totals().collect()} == {"v1": 1, "v2": 3}
    empty = tokencounts.TokenTotals(spark, folder, version="v3")
    assert empty.commit("1", inserts=docs.limit(0)) and empty.commit("2") and empty.totals().count() == 2


PAGES = [
    '<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad --><div class="ad">Buy this now</div>'
    "<article><h1>{h}</h1><p><b>{a}<br><p>{b} &amp; more&nbsp;text.</p></article><footer>&copy; site</footer></body></html>",
]


def pages(n=60):
    rng = random.Random(6)
    say = lambda k: " ".join("".join(rng.choice(["the", "on", "er", "in", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(k))
    rows, want = [], {}
    for k in range(n):
        h, a, b = say(4), say(rng.randrange(3, 40)), say(rng.randrange(5, 90))
        source = PAGES[0].format(h=h, a=a, b=b)
        if k % 7 == 0:
            source = source[: source.index("</article>")]
        rows.append((k, f"http://x/{k}", source))
        want[k] = f"{h} {a} {b} & more text."
    return rows, want


@pytest.fixture(scope="module")
def trees(spark):
    rows, _ = pages()
    return htmlmain.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_main_text(spark, trees):
    rows, want = pages()
    rows += [(900, None, None), (901, "u", ""), (902, "u", "<p"), (903, "u", "<div><script>alert(1)")]
    got = {r.page_id: r for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()}
    assert all(got[k].text == t and got[k].n_chars == len(t) for k, t in want.items())
    assert [got[k].text for k in (900, 901, 903)] == ["", "", ""]


def test_main_text_without_semantic_tags(spark, trees):
    rng = random.Random(8)
    say = lambda k: " ".join("".join(rng.choice(["the", "on", "er", "in", "st"]) for _ in range(2)) for _ in range(k))
    rows, want = [], {}
    for k in range(20):
        body = [say(40), say(30)]
        links = "".join(f'<li><a href="#">{say(1)}</a></li>' for _ in range(6))
        rows.append((k, f'<body><div class="menu"><ul>{links}</ul></div><div class="post-content"><p>{body[0]}</p><p>{body[1]}</p></div><div class="comments"><div class="comment"><p>{say(12)}</p></div></div><div class="site-footer">{say(4)}</div></body>'))
        want[k] = " ".join(body)
    got = {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, html string"), trees).collect()}
    assert sum(got[k] == t for k, t in want.items()) >= 18


def test_decoding_never_contradicts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        content = htmltree.decode(parent, rng.random(n))
        for i in range(1, n):
            if content[i]:  # above content is content, or nothing but outside
                j, left = parent[i], False
                while j >= 0:
                    left |= not content[j]
                    assert not (left and content[j])
                    j = parent[j]


def test_parser_reads_entities_and_broken_markup():
    page = htmltree.parse("<p>a &lt;b&gt; <i>c</i>d<p>e<script>x<y</script>f<!-- g --><br/>h</div></p>i &#233;")
    assert htmltree.text_of(page, np.ones(len(page.parent), bool)) == html.unescape("a &lt;b&gt; cd ef h i é")


@pytest.mark.parametrize("tag", sorted(htmltree.RAW))
def test_letters_that_grow_in_lower_case_lose_no_text(tag):
    page = htmltree.parse(f"<body><article><p>{'İ' * 12}stanbul</p><{tag}>x<y</{tag.upper()}><p>after</p></article><p>end</p></body>")
    assert htmltree.text_of(page, np.ones(len(page.parent), bool)) == f"{'İ' * 12}stanbul after end"


def test_no_pages_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    model = htmlmain.fit(none)
    assert htmlmain.extract(none, model).count() == 0
    assert htmlmain.extract(spark.createDataFrame([(1, "<nav>n</nav><article><p>t</p></article>")], "page_id long, html string"), model).first().text == "t"


def test_pipeline_on_a_small_corpus(spark, folder):
    import corpus_pipeline

    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    passage = say(30)
    rows = [(k, say(80) + ".\nRead more at our site", "en", "s", 0) for k in range(30)]
    rows += [(100, rows[3][1].replace("Read more", "read more"), "en", "s", 0), (101, say(60) + " " + passage + " " + say(60), "en", "s", 0), (102, "spam " * 300, "en", "s", 0), (103, None, "en", "s", None), (104, rows[5][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k == 7)) for k in range(0, 30, 2)] + [(7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        path = f"{folder}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    left = {r.doc_id: r for r in docs.collect()}
    assert set(left) == {*range(30), 101}
    assert all("ead more" not in r.text and r.n_chars == len(r.text) for r in left.values()) and passage not in left[101].text
    out = corpus_pipeline.run(spark, folder)
    assert out.filter("n_copies > 0").count() == out.count() >= 20
    assert out.select(F.countDistinct("doc_id")).first()[0] == out.count()
