"""Query of operator 5: documents mixed so that a source's share is the square root of its bytes, budget as the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing
from tessera.llm.common import table

SEED, EXPONENT = 42, 0.5


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.rates(docs, exponent=EXPONENT), seed=SEED)


ORACLE = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN (sum(bytes) OVER ())::DOUBLE * (pow(bytes::DOUBLE, {EXPONENT}) / sum(pow(bytes::DOUBLE, {EXPONENT})) OVER ()) / bytes ELSE 1.0 END AS rate FROM sizes),
probability AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, generate_series(0, 200) AS g(k)),
named AS (SELECT d.*, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS name FROM documents d),
drawn AS (SELECT d.*, ('0x' || substr(md5(name || ':{SEED}:0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM named d),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.name, count(*) FILTER (p.cdf <= d.u) AS n_copies
  FROM drawn d JOIN probability p ON d.source IS NOT DISTINCT FROM p.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies::INTEGER AS n_copies, c::INTEGER AS copy, md5(name || ':{SEED}:copy:' || c) AS mix_key
FROM counted, LATERAL (SELECT unnest(generate_series(0, n_copies - 1)) AS c)
WHERE n_copies > 0
"""
