import pyarrow as pa

from siftwell import session
from siftwell.plans.catalogue import QUERIES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_queries_hold_batches_to_bytes(spark):
    """Batches are bounded by what rows weigh, not by their number; a session's own lower bound stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.set(KEY, "64m")
    QUERIES["unicode_nfc"](spark, "/root/testdata/sf0.001")
    heavy = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) AS t")
    got = [r.n for r in heavy.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 5 and max(got) < session.BATCH_BYTES + 200_000
    spark.conf.set(KEY, "1000")
    QUERIES["unicode_nfc"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(KEY) in ("1000", "1000b")
    spark.conf.unset(KEY)
