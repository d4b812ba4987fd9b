"""The whole chain on a random walk, in batch and live."""

from pyspark.sql import functions as F

from barloom.plans.pipeline import analyse, live, report
from tests.test_bars import make, walk


TFS, SWINGS = ["4H", "1H"], {"4H": 3, "1H": 3}


def test_chain_and_live(spark, tmp_path):
    base = make(spark, walk(700, 3)).drop("tf")
    found = analyse(base, TFS, swings=SWINGS, exhaustion={"4H": 1.5, "1H": 1.0})
    moves = found.movements.collect()
    assert {m.tf for m in moves} == {"4H", "1H"} and any(m.tf_parent_id for m in moves if m.tf == "1H")
    patterns = found.patterns.cache()
    assert {r.estado for r in patterns.collect()} <= {"VALIDADO", "PENDIENTE_VALIDACION"}
    assert "Patterns" in report(found) and "Matching now" in report(found)
    # three batches after a stored history give, after each, what a batch run over all bars so far gives
    bars = found.bars.cache()
    times = [r.ts for r in bars.select("ts").distinct().orderBy("ts").collect()]
    cuts = [times[len(times) * k // 10] for k in (7, 8, 9)]
    parts = [F.col("ts") <= cuts[0], (F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1]), (F.col("ts") > cuts[1]) & (F.col("ts") <= cuts[2]), F.col("ts") > cuts[2]]
    key = lambda df: sorted((r.symbol, r.variable, r.value, r.tf or "", r.direccion, r.n) for r in df.collect())
    for k, part in enumerate(parts[1:]):
        bars.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = live(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in")), patterns, bars.where(parts[0]), str(tmp_path / "out"), str(tmp_path / "ck"), TFS, SWINGS)
        query.processAllAvailable()
        query.stop()
    assert key(spark.read.parquet(str(tmp_path / "out/matches/batch=2"))) == key(found.matches)
