"""What the entry module registers of this subpackage."""

import corpus_pipeline
from tessera.llm import oracles, queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
