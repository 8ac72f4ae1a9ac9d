"""Query of operator 12: documents without the words of 20-word windows that start earlier elsewhere, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import recompress
from tessera.llm.common import table


def op12_recompressed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH parted AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(words[i : i + 19], ' ')) AS w FROM parted, LATERAL (SELECT unnest(generate_series(1, len(words) - 19)) AS i)),
later AS MATERIALIZED (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, generate_series(0, 19) AS g(k)),
listed AS MATERIALIZED (SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM parted),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT p.doc_id, len(words) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM parted p LEFT JOIN listed l ON p.doc_id = l.doc_id LEFT JOIN kept k ON p.doc_id = k.doc_id
"""
