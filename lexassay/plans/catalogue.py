"""All core queries with the SQL they are compared with."""

from __future__ import annotations

from lexassay.operators import multivalue, nested
from lexassay.sources.tables import table

from . import corpus_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL, Query, query

FLAGSHIP = "symbol_confusion"


# The calls of the service log as SQL, used by the comparisons of problem 4.
CALLS = """WITH p AS (SELECT log_id, payload::JSON AS j FROM service_log WHERE json_valid(payload)),
r AS (SELECT log_id, coalesce(j->'query', j->'request'->'query') AS q, coalesce(j->'data', j->'response'->'data') AS d FROM p),
x AS (SELECT log_id, d, CASE WHEN json_type(q) = 'VARCHAR' THEN (q->>'$')::JSON ELSE q END AS q FROM r),
st AS (SELECT log_id, i, q->'stems'->i::BIGINT AS s FROM (SELECT *, unnest(range(json_array_length(q->'stems')::BIGINT))::INT AS i FROM x WHERE json_type(q->'stems') = 'ARRAY')),
op AS (SELECT log_id, i, s->'options' AS o FROM st WHERE json_type(s->'options') = 'OBJECT'
  UNION ALL SELECT log_id, i, s->'options'->k::BIGINT FROM (SELECT *, unnest(range(json_array_length(s->'options')::BIGINT))::INT AS k FROM st WHERE json_type(s->'options') = 'ARRAY')),
an AS (SELECT log_id, i, q->'answers'->i::BIGINT AS a FROM (SELECT *, unnest(range(json_array_length(q->'answers')::BIGINT))::INT AS i FROM x WHERE json_type(q->'answers') = 'ARRAY')),
rp AS (SELECT log_id, d->(json_keys(d)[1]) AS r FROM x WHERE json_type(d) = 'OBJECT' AND len(json_keys(d)) > 0),
se AS (SELECT log_id, i, r->i::BIGINT->'error_detail' AS e FROM (SELECT *, unnest(range(json_array_length(r)::BIGINT))::INT AS i FROM rp))"""


@query()
def p2_found(spark, folder):
    return multivalue.answer_values(table(spark, folder, "questions"))


@query(
    CALLS
    + """
SELECT log_id, 'stem' AS entity, i, '' AS j, s->>'stem' AS value FROM st WHERE s->>'stem' <> ''
UNION ALL SELECT log_id, 'option', i, k, o->>k FROM (SELECT *, unnest(json_keys(o)) AS k FROM op) WHERE o->>k IS NOT NULL
UNION ALL SELECT log_id, 'answer', 0, '0', q->>'answers' FROM x WHERE json_type(q->'answers') = 'VARCHAR'
UNION ALL SELECT log_id, 'answer', i, '0', a->>'$' FROM an WHERE json_type(a) = 'VARCHAR'
UNION ALL SELECT log_id, 'answer', i, k::VARCHAR, a->>k::BIGINT FROM (SELECT *, unnest(range(json_array_length(a)::BIGINT))::INT AS k FROM an WHERE json_type(a) = 'ARRAY') WHERE a->>k IS NOT NULL
UNION ALL SELECT log_id, 'error', i, k::VARCHAR, coalesce(e->k::BIGINT->>'error_type', '') FROM (SELECT *, unnest(range(json_array_length(e)::BIGINT))::INT AS k FROM se WHERE json_type(e) = 'ARRAY')"""
)
def p4_found(spark, folder):
    return nested.call_entities(table(spark, folder, "service_log"))


@query(CALLS + "SELECT log_id, log_id || '|query.stems[]|' || i AS node, log_id || '||' AS parent, i AS ordinal, NULL::VARCHAR AS name, s->>'stem' AS value FROM st")
def p4_stems(spark, folder):
    return nested.call_table(table(spark, folder, "service_log"), "stem")


@query(
    CALLS
    + """, k AS (SELECT log_id, i, '|query.stems[].options.*|' || i AS place, o, unnest(json_keys(o)) AS k FROM (SELECT log_id, i, s->'options' AS o FROM st WHERE json_type(s->'options') = 'OBJECT')
  UNION ALL SELECT log_id, i, '|query.stems[].options[].*|' || i || '.' || n, o, unnest(json_keys(o)) FROM (SELECT log_id, i, n, s->'options'->n::BIGINT AS o FROM (SELECT *, unnest(range(json_array_length(s->'options')::BIGINT))::INT AS n FROM st WHERE json_type(s->'options') = 'ARRAY'))),
m AS (SELECT *, (row_number() OVER (PARTITION BY log_id, place ORDER BY k) - 1)::INT AS m FROM k)
SELECT log_id, log_id || place || '.' || m AS node, log_id || '|query.stems[]|' || i AS parent, m AS ordinal, k AS name, o->>k AS value FROM m"""
)
def p4_options(spark, folder):
    return nested.call_table(table(spark, folder, "service_log"), "option")


@query(
    CALLS
    + """
SELECT log_id, log_id || '||' AS node, NULL::VARCHAR AS parent, 0 AS ordinal, NULL::VARCHAR AS name, q->>'answers' AS value FROM x WHERE json_type(q->'answers') = 'VARCHAR'
UNION ALL SELECT log_id, log_id || '|query.answers[]|' || i, log_id || '||', i, NULL, CASE WHEN json_type(a) <> 'ARRAY' THEN a->>'$' END FROM an
UNION ALL SELECT log_id, log_id || '|query.answers[][]|' || i || '.' || k, log_id || '|query.answers[]|' || i, k, NULL, a->>k::BIGINT FROM (SELECT *, unnest(range(json_array_length(a)::BIGINT))::INT AS k FROM an WHERE json_type(a) = 'ARRAY')"""
)
def p4_answers(spark, folder):
    return nested.call_table(table(spark, folder, "service_log"), "answer")


@query(
    CALLS
    + """
SELECT log_id, log_id || '|report[].error_detail[]|' || i || '.' || k AS node, log_id || '|report[]|' || i AS parent, k AS ordinal, NULL::VARCHAR AS name, e->k::BIGINT->>'error_type' AS value FROM (SELECT *, unnest(range(json_array_length(e)::BIGINT))::INT AS k FROM se WHERE json_type(e) = 'ARRAY')"""
)
def p4_errors(spark, folder):
    return nested.call_table(table(spark, folder, "service_log"), "error")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
