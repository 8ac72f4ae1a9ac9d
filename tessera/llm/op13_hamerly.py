"""Query of operator 13: codes of all embeddings in 8 parts of 16 entries after 6 rounds, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hamerly
from tessera.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hamerly.Compressor(PARTS, ENTRIES, ROUNDS, SCALE)
    coded = hamerly.label_errors(made.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(made.seal()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Plain rounds: every part against every entry."""
    tables = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS number FROM kept)",
        f"parts AS (SELECT number, p AS part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM numbered, generate_series(0, {PARTS - 1}) AS g(p))",
        f"book0 AS (SELECT part, number - 1 AS entry, x AS c FROM parts WHERE number <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        tables.append(
            f"near{k} AS (SELECT number, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT number, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} USING (part)) GROUP BY number, part)"
        )
        if k < ROUNDS:
            tables.append(
                f"mean{k} AS (SELECT part, entry, list(m ORDER BY place) AS c FROM (SELECT part, best.entry AS entry, place, ((sum(x[place]) - ((sum(x[place]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM near{k}, generate_series(1, len(x)) AS g(place) GROUP BY ALL) GROUP BY ALL)"
            )
            tables.append(f"book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    tables.append(f"coded AS (SELECT number, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY number)")
    tables.append(f"seal AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})")
    return f"""WITH {", ".join(tables).replace("AS (", "AS MATERIALIZED (")}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM numbered JOIN coded USING (number), seal"""


ORACLE = _oracle()
