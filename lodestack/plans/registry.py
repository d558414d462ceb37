"""All registered queries, their oracle SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, judgments, outcomes
from . import context_queries, graph_queries, lint_queries, outcome_queries, stream_queries, text_queries
from .views import view, with_views

MODULES = (context_queries, text_queries, outcome_queries, graph_queries, lint_queries, stream_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: what its responses resolve to, at what confidence, and the tokens of the cases with the response's id.

    Responses are judged, mapped and routed; cancelled ones leave. One shuffle by case joins the tokens.
    """
    judged = judgments.parse_judgments(view(spark, sf_dir, "v_responses"), "raw", F.lit(text_queries.ALLOWED)).drop("raw")
    named = judgments.map_outcome(judged.withColumnRenamed("outcome", "index"), "index", {"0": "Yes", "1": "No", "2": "Other"})
    routed = graphs.route(named, {"resolved": F.col("outcome") != "inconclusive", "open": F.col("outcome") == "inconclusive"})
    cost = outcomes.usage_totals(view(spark, sf_dir, "v_attempts"))
    j = routed.join(cost, routed["doc_id"] == cost["run_id"], "left")
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return j.groupBy("source", "branch", "outcome", "confidence").agg(F.count("*").alias("n"), tokens("input_tokens"), tokens("output_tokens"))


FLAGSHIP = f"""SELECT source, branch, outcome, confidence, count(*) AS n, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
  FROM (SELECT j.doc_id, confidence, CASE outcome WHEN '0' THEN 'Yes' WHEN '1' THEN 'No' WHEN '2' THEN 'Other' ELSE outcome END AS outcome, CASE WHEN outcome = 'inconclusive' THEN 'open' ELSE 'resolved' END AS branch FROM ({text_queries.JUDGED}) j) r
  JOIN documents d ON d.doc_id = r.doc_id
  LEFT JOIN (SELECT run_id, sum(CASE WHEN status <> 'failed' THEN input_tokens ELSE 0 END) AS input_tokens, sum(CASE WHEN status <> 'failed' THEN output_tokens ELSE 0 END) AS output_tokens FROM v_attempts GROUP BY run_id) u ON u.run_id = r.doc_id
  GROUP BY source, branch, outcome, confidence"""

QUERIES = {"flagship": flagship, **{k: v for m in MODULES for k, v in m.Q.items()}}
ORACLE_SQL = {"flagship": with_views(FLAGSHIP), **{k: v for m in MODULES for k, v in m.SQL.items()}}
