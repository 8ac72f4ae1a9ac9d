"""Schemas of the logical tables, as DDL."""

DEPENDENCY = "MAP<STRING, ARRAY<STRING>>"
TASK = f"id STRING, taskid STRING, description STRING, dependency {DEPENDENCY}, origin_dependency {DEPENDENCY}, target_dependency {DEPENDENCY}, true_dependency {DEPENDENCY}, origin_code STRING, testcode STRING"
CORPUS_DOC = "path STRING, doc STRING, module STRING, aliases ARRAY<STRING>, members STRING, type STRING, signature STRING"
PREDICTION = "id STRING, answer STRING, pred STRING, model_output ARRAY<STRING>"
DIAGNOSTIC = "file STRING, severity STRING, message STRING, rule STRING, range STRUCT<start: STRUCT<line: INT, character: INT>, end: STRUCT<line: INT, character: INT>>"
CONTEXT_RESULT = f"id STRING, original_item_id STRING, query_index INT, dedup_key STRING, query STRING, target_api STRING, dependencies {DEPENDENCY}, retrieval_method STRING, context STRING, context_length BIGINT, success BOOLEAN, error STRING"
EVALUATION = "task_id STRING, passed BOOLEAN, error_type STRING, message STRING, test_stats STRUCT<total_tests: INT, passed_tests: INT, failed_tests: INT, error_tests: INT, skipped_tests: INT>"
INSTRUCTION = "pkg STRING, version STRING, instruction STRING, input STRING, output STRING"
