"""Every query of the engine by name, with its SQL where there is one."""

from quarryline.plans import changes, code, documents, ingest, knowledge, references, verdicts

_PARTS = (changes, code, documents, ingest, knowledge, references, verdicts)

QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
