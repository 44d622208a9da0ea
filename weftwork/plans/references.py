"""Queries on dangling references."""

from __future__ import annotations

import re

from weftwork.functions.text import BLANK
from weftwork.operators.references import dangling_ends, dangling_report
from weftwork.sources.tables import table


def p2_found(spark, folder):
    return dangling_ends(table(spark, folder, "nodes"), table(spark, folder, "edges")).select("edge_key", "ref_end").distinct()


def p2_report(spark, folder):
    return dangling_report(table(spark, folder, "nodes"), table(spark, folder, "edges"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

#: A character that is not in weftwork.functions.text.BLANK, in RE2 notation.
VISIBLE = "[^" + re.sub(r"\\u(\w{4})", r"\\x{\1}", BLANK) + "]"

_ENDS = f"""
  ends AS (
    SELECT edge_key, 'source' AS ref_end, graph_id, source AS ref, arrived_at FROM edges
    UNION ALL SELECT edge_key, 'target', graph_id, target, arrived_at FROM edges),
  refs AS (SELECT * FROM ends WHERE ref IS NOT NULL AND regexp_matches(ref, '{VISIBLE}')),
  bad AS (SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM nodes n WHERE n.graph_id = r.graph_id AND n.id = r.ref AND n.arrived_at <= r.arrived_at
      AND (n.deleted_at IS NULL OR n.deleted_at > r.arrived_at)))"""

ORACLE = {
    "p2_found": f"WITH {_ENDS} SELECT DISTINCT edge_key, ref_end FROM bad",
    "p2_report": f"""WITH {_ENDS},
  total AS (SELECT ref_end, coalesce(strftime(date_trunc('month', arrived_at), '%Y-%m-%d'), 'unknown') AS period, count(*) AS n_refs FROM refs GROUP BY 1, 2),
  lost AS (SELECT ref_end, coalesce(strftime(date_trunc('month', arrived_at), '%Y-%m-%d'), 'unknown') AS period, count(*) AS n FROM bad GROUP BY 1, 2)
  SELECT 'edges' AS table_name, total.ref_end, total.period, n_refs, coalesce(lost.n, 0) AS n_dangling
  FROM total LEFT JOIN lost ON total.ref_end = lost.ref_end AND total.period = lost.period""",
}
