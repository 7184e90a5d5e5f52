"""The jobs as registered queries: each runs twice over the whole tables into one new folder, and its output is read back."""

from __future__ import annotations

import uuid

from jobs import policy_corpus, run_ledger
from jobs.common import load
from routeloom.plans.registry import query
from routeloom.storage import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH t AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
  u AS (SELECT conv_id, turn, list_slice(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 3), 1, 8) AS words FROM t WHERE role = 'user'),
  d AS (SELECT u.conv_id || '-' || u.turn AS pair_id, CAST(u.turn AS INT) AS depth, words,
    list_position(list_transform(words, lambda w: list_contains(list_transform(string_split_regex(a.text, '[^A-Za-z]+'), lambda x: lower(x)), lower(w))), true) - 1 AS choice,
    'Target molecule: ' || words[1] || chr(10) || 'Frontier candidates:' || chr(10) || array_to_string(list_transform(words, lambda w, i: '[' || (i - 1) || '] ' || w || ' | depth=' || u.turn), chr(10)) AS prompt
    FROM u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE len(words) > 0),
  b AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 7),
  c AS (SELECT * FROM d WHERE choice >= 0 AND NOT list_has_any(list_transform(words, lambda w: lower(w)), (SELECT coalesce(list(w), []) FROM b))),
  o AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY pair_id) = 1),
  s AS (SELECT count(*) FILTER (WHERE depth >= 4) AS deep, CAST(ceil(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS lim FROM o),
  k AS MATERIALIZED (SELECT * FROM o WHERE depth >= 4 UNION ALL
    SELECT * FROM o WHERE depth < 4 QUALIFY row_number() OVER (ORDER BY md5('4:' || pair_id), pair_id) <= (SELECT greatest(0, lim - deep) FROM s)),
  g AS (SELECT DISTINCT 'Target molecule: ' || words[1] AS g FROM k),
  h AS (SELECT g FROM g QUALIFY row_number() OVER (ORDER BY md5('4:' || g), g) <= (SELECT greatest(1, CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT)) FROM g))
  SELECT pair_id, prompt, '{"choice": ' || choice || '}' AS answer, CASE WHEN 'Target molecule: ' || words[1] IN (SELECT g FROM h) THEN 'validation' ELSE 'train' END AS split, depth FROM k"""
)
def job1_policy_corpus(spark, d):
    """The corpus of the batch job."""
    out = _folder(spark, "job1")
    for _ in range(2):
        policy_corpus.run(spark, f"{d}/conversations.parquet", f"{d}/benchmark.parquet", out, load(policy_corpus.Settings))
    found = policy_corpus.read(spark, out)
    return found.selectExpr("pair_id", "prompt[1].content AS prompt", "completion[0].content AS answer", "split", "depth")


@query(
    """WITH r AS (SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS day, event_type AS policy, CAST(json_extract(props, '$.k') AS INT) % 3 AS seed, CAST(floor(value) AS INT) AS steps, value FROM events),
  b AS (SELECT unnest([1, 5, 10, 25, 50, 100]) AS budget)
  SELECT day, policy, seed, budget, count(*) AS runs, count(*) FILTER (WHERE value < 60 AND steps <= budget) AS solved,
    CAST(sum(least(least(100, steps + 1), budget)) AS BIGINT) AS expansions, round(sum(value / 8), 6) AS seconds FROM r, b GROUP BY ALL"""
)
def job2_run_ledger(spark, d):
    """The sums of the incremental job; its second run finds nothing new."""
    out, checkpoint = _folder(spark, "job2"), _folder(spark, "job2-checkpoint")
    for _ in range(2):
        run_ledger.run(spark, f"{d}/events.parquet*", out, checkpoint, load(run_ledger.Settings))
    return run_ledger.read(spark, out)
