"""Packages of documents and canonical JSON by small cases."""

from pyspark.sql import functions as F

from tessera.operators import documents


def test_package_of_document(spark):
    cases = {
        '{"path": "numpy.sum", "aliases": ["torch.sum"]}': ("path", "numpy"),
        '{"path": "np.sum", "aliases": [3, "scipy.x", "torch.sum", "numpy.sum"], "docstring": "pandas"}': ("alias", "torch"),
        '{"path": "np.sum", "aliases": "torch.sum", "docstring": "as in pandas or numpy"}': ("content", "numpy"),
        '{"path": "np.sum", "docstring": "", "content": "see pandas"}': ("content", "pandas"),
        '{"path": "np.sum", "other": "torch"}': ("content", "torch"),
        '{"path": "np.sum", "docstring": "nothing here", "other": "torch"}': None,
        '{"path": 5, "aliases": [null]}': None,
        '["numpy"]': ("content", "numpy"),
        "no JSON, but pandas": ("content", "pandas"),
        "none": None,
        None: None,
    }
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(cases)], "i int, d string")
    packages = F.array(*[F.lit(p) for p in ("torch", "numpy", "pandas")])
    found = rows.select("i", documents.package_of_document(F.col("d"), packages).alias("p")).orderBy("i").collect()
    assert [tuple(r["p"]) if r["p"] else None for r in found] == list(cases.values())


def test_canonical(spark):
    texts = ['{"b": 1, "a": [2, {"d": null, "c": "x"}]}', '{"a":[2,{"c":"x","d":null}],"b":1}', '{"a":[{"c":"x","d":null},2],"b":1}', '"text"', "not json", None]
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(documents.canonical(F.col("t"))).collect()]
    assert found[0] == found[1] != found[2] and found[3:] == ['"text"', "not json", None]
