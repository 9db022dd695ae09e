"""Column functions over Arrow batches that are worked on in pieces: a batch may hold ten thousand rows, Python objects are made of few at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows of a piece.
ROWS = 64


def by_pieces(kind: DataType, rows: int = ROWS):
    """A column function of one column from work: the values of a piece -> an Arrow array (or the values) of as many results."""

    def made(work: Callable[[list], object]):
        arrow = to_arrow_type(kind)

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                for i in range(0, len(part), rows):
                    found = work(part.slice(i, rows).to_pylist())
                    yield found.cast(arrow) if isinstance(found, pa.Array) else pa.array(found, arrow)

        run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)

    return made
