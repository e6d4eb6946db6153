"""SQL fragments that spell the engine's expressions for the comparison engine."""

from gleanset import fixed
from gleanset.catalog.fixtures import ANSWERED, EN_RAW, VI_RAW

SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{SPACE}]+')) AS BIGINT)"


def clean(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), 'https?://[^{SPACE}]+', '', 'g')"
    bare = rf"regexp_replace(regexp_replace({bare}, '@[{WORD}]+', '', 'g'), '\$[{WORD}]+', '', 'g')"
    return strip(bare)


def map_terms(x: str) -> str:
    whens = " ".join(
        f"WHEN {x} IN ({', '.join(repr(t) for t in terms)}) THEN '{name}'" for name, terms in fixed.LABEL_TERMS.items()
    )
    return f"CASE {whens} END"


def map_codes(x: str, codes=fixed.SENTIMENT_CODES) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.items()) + " END"


def parse(x: str) -> str:
    answer = strip(f"lower({x})")
    order = ("positive", "negative", "neutral")
    whole = " ".join(
        f"WHEN regexp_matches({answer}, '(^|[^{WORD}]){w}([^{WORD}]|$)') THEN '{w}'" for w in order
    )
    part = " ".join(f"WHEN contains({answer}, '{w}') THEN '{w}'" for w in order)
    head = f"regexp_replace(regexp_extract({answer}, '[^{SPACE}]+'), '[^{WORD}]', '', 'g')"
    return f"CASE {whole} {part} WHEN {head} IN {order} THEN {head} ELSE 'unparseable' END"


def draw(seed: int = fixed.SEED) -> str:
    return f"md5(concat('{seed}:', id)), id"


_LISTED = ", ".join("'" + s + "'" for s in fixed.CONTRADICTED_SENTENCES)

EN_CLEAN = f"""{EN_RAW},
en_first AS (SELECT * FROM en_raw QUALIFY row_number() OVER (PARTITION BY input ORDER BY id) = 1),
en_cleaned AS (SELECT id, {clean('input')} AS input, output FROM en_first),
en_long AS (SELECT * FROM en_cleaned WHERE {words('input')} >= 3 AND regexp_matches(input, '[a-zA-Z]')),
en AS (SELECT id, input, label FROM (SELECT *, {map_terms('output')} AS label FROM en_long) WHERE label IS NOT NULL)"""

VI_CLEAN = f"""{VI_RAW},
vi_unlisted AS (SELECT * FROM vi_raw WHERE sentence NOT IN ({_LISTED})),
vi_first AS (SELECT * FROM vi_unlisted QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY id) = 1),
vi_long AS (SELECT * FROM vi_first WHERE {words('sentence')} >= 2),
vi AS (SELECT id, input, label FROM
  (SELECT id, sentence AS input, {map_codes('sentiment')} AS label FROM vi_long) WHERE label IS NOT NULL)"""


def balanced(rows: str, name: str, e_rows: int, t_rows: int) -> str:
    """Step-by-step equal-class split: eval, eval top-up, train, train top-up."""
    e, t = e_rows // 3, t_rows // 3
    return f"""
{name}_r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {draw()}) AS r FROM {rows}),
{name}_e1 AS (SELECT id, label FROM {name}_r WHERE r <= {e}),
{name}_p1 AS (SELECT id, label, row_number() OVER (ORDER BY {draw()}) AS r FROM {rows}
  WHERE id NOT IN (SELECT id FROM {name}_e1)),
{name}_e2 AS (SELECT id, label FROM {name}_p1
  WHERE r <= {e_rows} - (SELECT count(*) FROM {name}_e1)
    AND (SELECT count(*) FROM {name}_p1) >= {e_rows} - (SELECT count(*) FROM {name}_e1)),
{name}_rest AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {draw()}) AS r FROM {rows}
  WHERE id NOT IN (SELECT id FROM {name}_e1 UNION ALL SELECT id FROM {name}_e2)),
{name}_t1 AS (SELECT id, label FROM {name}_rest WHERE r <= {t}),
{name}_p2 AS (SELECT id, label, row_number() OVER (ORDER BY {draw()}) AS r FROM {name}_rest
  WHERE id NOT IN (SELECT id FROM {name}_t1)),
{name}_t2 AS (SELECT id, label FROM {name}_p2
  WHERE r <= {t_rows} - (SELECT count(*) FROM {name}_t1)
    AND (SELECT count(*) FROM {name}_p2) >= {t_rows} - (SELECT count(*) FROM {name}_t1)),
{name} AS (SELECT id, label, 'eval' AS split FROM {name}_e1 UNION ALL SELECT id, label, 'eval' FROM {name}_e2
  UNION ALL SELECT id, label, 'train' FROM {name}_t1 UNION ALL SELECT id, label, 'train' FROM {name}_t2)"""


def scarce_first(rows: str, name: str, e_rows: int, t_rows: int) -> str:
    """Step-by-step split that serves the neutral class first and shares out what it lacks."""
    e, t = e_rows // 3, t_rows // 3
    others = "('positive', 'negative')"
    return f"""
{name}_r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {draw()}) AS r FROM {rows}),
{name}_e1 AS (SELECT id, label FROM {name}_r WHERE label = 'neutral' AND r <= {e}),
{name}_t1 AS (SELECT id, label FROM {name}_r WHERE label = 'neutral' AND r > {e} AND r <= {e + t}),
{name}_g AS (SELECT {e} + ({e} - (SELECT count(*) FROM {name}_e1)) // 2 AS ge,
                    {t} + ({t} - (SELECT count(*) FROM {name}_t1)) // 2 AS gt),
{name}_e2 AS (SELECT id, label FROM {name}_r, {name}_g WHERE label IN {others} AND r <= ge),
{name}_t2 AS (SELECT id, label FROM {name}_r, {name}_g WHERE label IN {others} AND r > ge AND r <= ge + gt),
{name}_ev AS (SELECT * FROM {name}_e1 UNION ALL SELECT * FROM {name}_e2),
{name}_tr AS (SELECT * FROM {name}_t1 UNION ALL SELECT * FROM {name}_t2),
{name}_p1 AS (SELECT id, label, row_number() OVER (ORDER BY {draw()}) AS r FROM {rows}
  WHERE id NOT IN (SELECT id FROM {name}_ev UNION ALL SELECT id FROM {name}_tr)),
{name}_e3 AS (SELECT id, label FROM {name}_p1 WHERE r <= {e_rows} - (SELECT count(*) FROM {name}_ev)
  AND (SELECT count(*) FROM {name}_p1) >= {e_rows} - (SELECT count(*) FROM {name}_ev)),
{name}_p2 AS (SELECT id, label, row_number() OVER (ORDER BY {draw()}) AS r FROM {name}_p1
  WHERE id NOT IN (SELECT id FROM {name}_e3)),
{name}_t3 AS (SELECT id, label FROM {name}_p2 WHERE r <= {t_rows} - (SELECT count(*) FROM {name}_tr)
  AND (SELECT count(*) FROM {name}_p2) >= {t_rows} - (SELECT count(*) FROM {name}_tr)),
{name} AS (SELECT id, label, 'eval' AS split FROM {name}_ev UNION ALL SELECT id, label, 'eval' FROM {name}_e3
  UNION ALL SELECT id, label, 'train' FROM {name}_tr UNION ALL SELECT id, label, 'train' FROM {name}_t3)"""


# Predictions melted to one row per example and model, with every language also as 'overall'.
MELTED = f"""{ANSWERED},
parsed AS (SELECT id, language, ground_truth AS truth, {parse('baseline_raw_output')} AS baseline,
  {parse('finetuned_raw_output')} AS finetuned FROM answers),
melted AS (SELECT id, language, truth, 'baseline' AS model, baseline AS pred FROM parsed
  UNION ALL SELECT id, language, truth, 'finetuned', finetuned FROM parsed),
scored AS (SELECT * FROM melted UNION ALL SELECT id, 'overall', truth, model, pred FROM melted),
sure AS (SELECT * FROM scored WHERE pred <> 'unparseable'),
report AS (
  SELECT model, language, c.class, count(*) FILTER (truth = c.class AND pred = c.class) AS tp,
         count(*) FILTER (pred = c.class) AS predicted, count(*) FILTER (truth = c.class) AS support
  FROM sure, (SELECT unnest(['negative', 'neutral', 'positive']) AS class) c GROUP BY 1, 2, 3),
rates AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
  FROM report),
acc AS (
  SELECT model, language, count(*) AS rows, count(*) FILTER (pred <> 'unparseable') AS parseable,
         count(*) FILTER (pred = truth) / count(*) AS accuracy_all,
         CASE WHEN count(*) FILTER (pred <> 'unparseable') = 0 THEN 0
              ELSE count(*) FILTER (pred = truth) / count(*) FILTER (pred <> 'unparseable') END AS accuracy_parseable
  FROM scored GROUP BY 1, 2),
macro AS (SELECT model, language, avg(f1) AS macro_f1 FROM rates GROUP BY 1, 2)"""
