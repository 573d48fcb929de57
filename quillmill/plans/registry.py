"""All registered queries outside the training-data operators."""

from quillmill.plans import evaluation, jobs, retail

QUERIES = {**retail.QUERIES, **evaluation.QUERIES, **jobs.QUERIES}
ORACLE_SQL = {**retail.ORACLE_SQL, **evaluation.ORACLE_SQL, **jobs.ORACLE_SQL}
