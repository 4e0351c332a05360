"""What Python holds at once does not grow with the batches that Spark sends."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from litmill.functions import hooks
from litmill.operators import rank


class Sent:
    schema = T.StructType().add("doc_id", "long").add("text", "string")

    def mapInPandas(self, run, schema):  # noqa: N802
        return lambda frame: list(run(iter([frame])))


FRAME = pd.DataFrame({"doc_id": range(1000), "text": [f"text {i}" for i in range(1000)]})


def test_vectors_leave_in_pieces():
    out = hooks.embed(Sent(), "text", lambda: hooks.hashed_words, 64)(FRAME)
    assert max(map(len, out)) == 64 and pd.concat(out)["doc_id"].tolist() == list(range(1000))
    assert pd.concat(out)["embedding"].tolist() == hooks.hashed_words(FRAME["text"].tolist())


def test_assessments_leave_in_pieces(spark):
    out = hooks.assess(Sent(), lambda r: [{"doc_id": r["doc_id"]}] * 2, "doc_id long")(FRAME)
    assert max(map(len, out)) == 128 and pd.concat(out)["doc_id"].tolist() == [i for i in range(1000) for _ in range(2)]


def test_lines_pass_a_root_element_as_they_are(spark):
    from litmill.catalog import scans

    batch = pa.RecordBatch.from_pydict({"value": ["<a/>", "<b/>"]})
    first, same, last = scans.wrapped("r")(iter([batch]))
    assert same is batch and (first.column(0)[0].as_py(), last.column(0)[0].as_py()) == ("<r>", "</r>")


def test_nearest_vectors_in_pieces(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = vectors.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.position): r.vec_id for r in rank.nearest_many(vectors, asked, 5, "vec_id", "embedding", piece=7).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = sorted(range(60), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:5]
        assert [got[q, p] for p in range(1, 6)] == order
