"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from packlens.functions import fixed_values as V
from packlens.sources import corpus as C


def table(name: str) -> str:
    """A derived corpus table as a CTE body."""
    sql = {"scans": C.SCANS, "products": C.PRODUCTS, "users": C.USERS, "images": C.IMAGES,
           "declarations": C.DECLARATIONS, "utterances": C.UTTERANCES, "messages": C.MESSAGES}[name]
    return f"{name} AS ({C.sql_tables(sql)})"


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(C.label_blocks_sql() if n == "blocks" else table(n) for n in names) + " "


def rx(pattern: str) -> str:
    """Case-insensitive pattern as a SQL string literal."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rx(pattern)})"


def cap(text: str, pattern: str, i: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {rx(pattern)}, {i}), '')"


def nutrition(text: str) -> str:
    return f"({has(text, V.NUTRITION_HEADER)} OR {has(text, V.NUTRITION_KEYWORD)})"


def conf(ocr: str, label: str, pattern: str, validity: str, spatial: str) -> str:
    d = "CAST({} AS DOUBLE)"
    return (
        f"round(least(1.0, {d.format(0.3)} * ({ocr}) + {d.format(0.25)} * CAST({label} AS DOUBLE) + {d.format(0.22)} * "
        f"CAST({pattern} AS DOUBLE) + {d.format(0.13)} * CAST({validity} AS DOUBLE) + {d.format(0.1)} * CAST({spatial} AS DOUBLE)), 4)"
    )


def values_map(mapping: dict[str, object]) -> str:
    """(k, v) rows of a fixed dictionary."""
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in mapping.items()) + ")"


# text lines of the derived labels: their blocks share a line exactly when they share y1
LINES = """
masked AS (SELECT b.*, {lex} OR EXISTS (SELECT 1 FROM blocks n WHERE n.image_id = b.image_id AND {nlex}
                 AND NOT (b.y2 < n.y1 - 10 OR b.y1 > n.y2 + 10)) AS nutrition FROM blocks b),
lines AS (SELECT image_id, y1, dense_rank() OVER (PARTITION BY image_id ORDER BY y1) - 1 AS line_no,
                 list(text ORDER BY x1) AS texts, list(block_id ORDER BY x1) AS ids, list(confidence ORDER BY x1) AS confs,
                 list(x1 ORDER BY x1) AS xs1, list(x2 ORDER BY x1) AS xs2,
                 bool_or(nutrition) AS nutrition, max(y2) AS y2, avg(y2 - y1) AS height, count(*) AS n
          FROM masked GROUP BY image_id, y1),
chained AS (SELECT *, array_to_string(texts, ' ') AS line_text, sum(brk) OVER (PARTITION BY image_id ORDER BY line_no) AS chain FROM
  (SELECT *, CASE WHEN y1 - lag(y2) OVER w > (height + lag(height) OVER w) / 2 * 1.8 THEN 1 ELSE 0 END AS brk
   FROM lines WINDOW w AS (PARTITION BY image_id ORDER BY line_no)) q)
""".format(lex=nutrition("b.text"), nlex=nutrition("n.text"))

SPANS = LINES + """,
spans AS MATERIALIZED (
  SELECT image_id, 0 AS stage, block_order AS a, 0 AS b, 0 AS c, text, CAST(block_id AS VARCHAR) AS block_ids, 1 AS n_blocks,
         FALSE AS is_multi, confidence AS ocr, nutrition, x1, y1, x2, y2
  FROM masked
  UNION ALL
  SELECT image_id, 1, line_no, 0, 0, line_text, array_to_string(ids, ','), n, FALSE, list_avg(confs), nutrition,
         list_min(xs1), y1, list_max(xs2), y2 FROM chained WHERE n > 1
  UNION ALL
  SELECT image_id, 1, line_no, k, s, array_to_string(texts[s + 1 : s + k], ' '), array_to_string(ids[s + 1 : s + k], ','), k, FALSE,
         list_avg(confs[s + 1 : s + k]), nutrition, list_min(xs1[s + 1 : s + k]), y1, list_max(xs2[s + 1 : s + k]), y2
  FROM chained, (SELECT unnest(range(2, 7)) AS k) ks, (SELECT unnest(range(0, 6)) AS s) ss WHERE k < n AND s + k <= n
  UNION ALL
  SELECT i.image_id, 2, i.line_no, j.line_no - i.line_no, 0, string_agg(m.line_text, chr(10) ORDER BY m.line_no),
         string_agg(array_to_string(m.ids, ','), ',' ORDER BY m.line_no),
         sum(m.n), TRUE, sum(list_sum(m.confs)) / sum(m.n), bool_or(m.nutrition), min(list_min(m.xs1)), min(m.y1), max(list_max(m.xs2)), max(m.y2)
  FROM chained i JOIN chained j ON j.image_id = i.image_id AND j.chain = i.chain AND j.line_no - i.line_no BETWEEN 1 AND 4
       JOIN chained m ON m.image_id = i.image_id AND m.line_no BETWEEN i.line_no AND j.line_no
  GROUP BY i.image_id, i.line_no, j.line_no)
"""


def spans_sql() -> str:
    return f"WITH {C.label_blocks_sql()}, {SPANS} "
