"""Each different name is compared once, and every part gets its match."""

from difflib import SequenceMatcher

from tessera.functions import pyfuncs
from tessera.plans import catalog


def test_names_are_compared_once(spark, tmp_path, monkeypatch):
    names, kinds = ["blue ring", "old plate", None, "zz", ""], ["RING", "PLATE", "BLUE", "OLD"]
    parts = [(k, f"b{k % 3}", names[k % 5], kinds[k % 4]) for k in range(600)] + [(7, "b0", "old plate", "X"), (9, None, "zz", "ZZ")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    compared = spark.sparkContext.accumulator(0)
    original = pyfuncs.sequence_ratio

    def counted(a, b):
        compared.add(1)
        return original(a, b)

    monkeypatch.setattr(pyfuncs, "ratio", pyfuncs._udf(counted, pyfuncs.T.DoubleType()))
    found = {r["p_partkey"]: (r["candidate"], r["score"]) for r in catalog.queries()["best_api_match"](spark, str(tmp_path)).collect()}
    expected = {}
    for key, brand, name, _ in parts:
        for candidate in {k.lower() for _, b, _, k in parts if b == brand and b is not None}:
            score = SequenceMatcher(None, name or "", candidate).ratio()
            if score > 0:
                expected[key] = min(expected.get(key, (0, "")), (-score, candidate))
    assert found == {k: (c, round(-s, 6)) for k, (s, c) in expected.items()}
    assert compared.value <= 2 * 3 * 5 * 5  # some plans evaluate a filter's function again
