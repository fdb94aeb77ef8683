from pyspark.sql import functions as F

from ledgerloom.functions.sizes import integer, listed, string, tx_sizes
from ledgerloom.operators.assembly import LOG, assemble


def test_lengths(spark):
    values = [0, 23, 24, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, -1, -24, -25, -257]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select(integer(F.col("n")).alias("a"), string(F.greatest("n", F.lit(0).cast("long"))).alias("b")).collect()
    assert [r["a"] for r in rows] == [1, 1, 2, 2, 3, 3, 5, 5, 9, 1, 1, 2, 3]
    assert [r["b"] for r in rows][:5] == [1, 24, 26, 257, 259]
    one = spark.createDataFrame([([1, 30],), ([],), (None,)], "x array<long>").select(listed(F.col("x"), integer).alias("n")).collect()
    assert [r["n"] for r in one] == [4, 1, 0]


def test_size_of_a_transaction(spark):
    """One input, one output without datum or asset, one signer: counted by hand."""
    def row(**given):
        return tuple(given.get(n) for n in LOG.names)

    log = [row(tx_id=1, seq=0, op="spend", src_tx_id=5, src_ix=0, witness="key"), row(tx_id=1, seq=1, op="pay", address=7, lovelace=3_000_000), row(tx_id=1, seq=2, op="sign", signer=9)]
    got = tx_sizes(assemble(spark.createDataFrame(log, LOG))).first()["base_size"]
    body = 1 + 1 + (1 + 1 + (1 + 34 + 1)) + (1 + 1 + (1 + 1 + 59 + 1 + 5)) + (1 + 1 + 30)
    assert got == 1 + body + (1 + 1 + 1 + (1 + 34 + 66)) + 1 + 1
