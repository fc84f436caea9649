"""DuckDB SQL of the registered queries, from shared pieces. Images are the 8x8 readings of ``embeddings``."""

from __future__ import annotations

PIXELS = """
pix AS (
  SELECT vec_id AS idx, label, i // 8 AS r, i % 8 AS c,
         least(255, greatest(0, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 510) AS INTEGER))) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i)
)"""

#: The same images at 28x28 by the nearest pixel.
LARGE = PIXELS + """,
big AS (
  SELECT idx, label, g.r, g.c, v
  FROM (SELECT i // 28 AS r, i % 28 AS c FROM (SELECT unnest(range(784)) AS i)) g
  JOIN pix ON pix.r = g.r * 8 // 28 AND pix.c = g.c * 8 // 28
)"""


def moved(source: str, side: int, ink: int, name: str = "cen", dx: str = "0", dy: str = "0") -> str:
    return f"""
box_{name} AS (
  SELECT idx, any_value(label) AS label, min(r) FILTER (v > {ink}) AS t, max(r) FILTER (v > {ink}) AS b, min(c) FILTER (v > {ink}) AS l, max(c) FILTER (v > {ink}) AS x
  FROM {source} GROUP BY idx
), shift_{name} AS (
  SELECT idx, label, t, b, l, x,
         CASE WHEN t IS NULL THEN 0 ELSE ({side} - 1 - t - b) // 2 + {dy} END AS down,
         CASE WHEN t IS NULL THEN 0 ELSE ({side} - 1 - l - x) // 2 + {dx} END AS across
  FROM box_{name}
), {name} AS (
  SELECT s.idx, s.label, s.r, s.c, coalesce(p.v, 0) AS v
  FROM {source} s JOIN shift_{name} h ON h.idx = s.idx
  LEFT JOIN {source} p ON p.idx = s.idx AND p.r = s.r - h.down AND p.c = s.c - h.across
)"""


def pooled(source: str, cell: str, name: str, factor: str, where: str = "true") -> str:
    """(idx, cell) of the cells at or above factor times the image mean."""
    return f"""
{name} AS (
  SELECT k.idx, k.cell FROM (SELECT idx, {cell} AS cell, sum(v) AS s, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL) k
  JOIN (SELECT idx, sum(v) AS s, count(*) AS n FROM {source} GROUP BY idx) m ON m.idx = k.idx
  WHERE k.s <> 0 AND CAST(k.s AS DOUBLE) / k.n >= CAST(m.s AS DOUBLE) / m.n * {factor}
)"""


def bits(cells: str, low: str, high: str) -> str:
    return f"""coalesce(bit_or(CAST(1 AS BIGINT) << CAST({low} AS INTEGER)) FILTER ({cells} < 48), 0) AS lo, coalesce(bit_or(CAST(1 AS BIGINT) << CAST({high} AS INTEGER)) FILTER ({cells} >= 48), 0) AS hi"""


CELL = "least(9, r * 10 // 8) * 9 + least(8, c * 9 // 8)"


def events(factor: str, source: str = "pix", name: str = "ev", carry: str = "idx, label") -> str:
    return pooled(source, CELL, f"hot_{name}", factor) + f""",
{name} AS (
  SELECT i.idx, any_value(i.label) AS label, {bits('cell', 'CASE WHEN cell < 48 THEN cell ELSE 0 END', 'CASE WHEN cell >= 48 THEN cell - 48 ELSE 0 END')}
  FROM (SELECT DISTINCT idx, label FROM {source}) i LEFT JOIN hot_{name} h ON h.idx = i.idx GROUP BY i.idx
)"""


F13 = "CAST(CAST(1.3 AS FLOAT) AS DOUBLE)"
EVENTS = "WITH " + PIXELS + "," + events(F13)

IOU = "CAST(bit_count(a.lo & p.lo) + bit_count(a.hi & p.hi) AS DOUBLE) / greatest(1, bit_count(a.lo | p.lo) + bit_count(a.hi | p.hi))"
MEMORY = """,
protos AS (
  SELECT label, slot, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS slot FROM ev WHERE idx % 5 <> 0) WHERE slot < 256
)"""
MATCHED = EVENTS + MEMORY + f""",
scored AS (SELECT a.idx, a.label AS actual, p.label, max({IOU}) AS score FROM ev a, protos p WHERE a.idx % 5 = 0 GROUP BY ALL),
best AS (
  SELECT idx, actual, label AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, label) AS k FROM scored) WHERE k = 1
)"""

FEATURES = "WITH " + LARGE + "," + moved("big", 28, 100)
for t in range(4):
    top, left = t // 2 * 14, t % 2 * 14
    cell = f"(r - {top}) * 6 // 14 * 8 + (c - {left}) * 8 // 14"
    inside = f"r >= {top} AND r < {top + 14} AND c >= {left} AND c < {left + 14}"
    for word, factor in (("lo", "CAST(0.7 AS DOUBLE)"), ("hi", "CAST(1.4 AS DOUBLE)")):
        # sums over a tile against the mean of the whole image
        FEATURES += f""",
t{t}{word} AS (
  SELECT k.idx, bit_or(CAST(1 AS BIGINT) << CAST(k.cell AS INTEGER)) AS w FROM (SELECT idx, {cell} AS cell, sum(v) AS s, count(*) AS n FROM cen WHERE {inside} GROUP BY ALL) k
  JOIN (SELECT idx, sum(v) AS s, count(*) AS n FROM cen GROUP BY idx) m ON m.idx = k.idx
  WHERE k.s <> 0 AND CAST(k.s AS DOUBLE) / k.n >= CAST(m.s AS DOUBLE) / m.n * {factor} GROUP BY k.idx
)"""

BANK = """
cells7 AS (SELECT i // 7 AS r, i % 7 AS c FROM (SELECT unnest(range(49)) AS i)),
shapes AS (
  SELECT 0 AS d, r, c FROM cells7 WHERE r = 3 UNION ALL SELECT 1, r, c FROM cells7 WHERE c = 3
  UNION ALL SELECT 2, r, c FROM cells7 WHERE r = c UNION ALL SELECT 3, r, c FROM cells7 WHERE r + c = 6
  UNION ALL SELECT 4, r, c FROM cells7 WHERE r = 1 OR c = 1
  UNION ALL SELECT 5, r, c FROM cells7 WHERE (r IN (0, 6) OR c IN (0, 6)) AND NOT (r = 0 AND c = 6) AND NOT (r = 6 AND c = 0)
),
moves(slot, dx, dy) AS (VALUES (0, -1, 0), (1, 0, -1), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 0, 1)),
bank AS (
  SELECT d, slot, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(b AS INTEGER)) FILTER (b < 48), 0) AS lo, coalesce(bit_or(CAST(1 AS BIGINT)) FILTER (b = 48), 0) AS hi
  FROM (SELECT d, slot, (r + dy) * 7 + c + dx AS b FROM shapes, moves WHERE r + dy BETWEEN 0 AND 6 AND c + dx BETWEEN 0 AND 6) GROUP BY d, slot
)"""
PATCHES = """,
cuts AS (SELECT idx, CAST(sum(v) AS DOUBLE) / count(*) * CAST(0.85 AS DOUBLE) AS cut FROM cen GROUP BY idx),
lit AS (
  SELECT idx, patch, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(b AS INTEGER)) FILTER (on_ AND b < 48), 0) AS lo, coalesce(bit_or(CAST(1 AS BIGINT)) FILTER (on_ AND b = 48), 0) AS hi
  FROM (SELECT p.idx, r // 7 * 4 + c // 7 AS patch, r % 7 * 7 + c % 7 AS b, v >= cut AND v <> 0 AS on_ FROM cen p JOIN cuts USING (idx)) GROUP BY idx, patch
),
found AS (
  SELECT idx, patch * 6 + d AS b FROM (
    SELECT a.idx, a.patch, p.d, max(""" + IOU + """) AS s FROM lit a, bank p GROUP BY ALL
  ) WHERE s >= CAST(CAST(0.16 AS FLOAT) AS DOUBLE)
),
patch_event AS (
  SELECT i.idx, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(CASE WHEN b < 48 THEN b ELSE 0 END AS INTEGER)) FILTER (b < 48), 0) AS lo,
         coalesce(bit_or(CAST(1 AS BIGINT) << CAST(CASE WHEN b >= 48 THEN b - 48 ELSE 0 END AS INTEGER)) FILTER (b >= 48), 0) AS hi
  FROM (SELECT DISTINCT idx FROM cen) i LEFT JOIN found USING (idx) GROUP BY i.idx
)"""
FEATURES = FEATURES.replace("WITH ", "WITH " + BANK + ",", 1) + PATCHES + """,
feats AS (
  SELECT i.idx, i.label, t.channel, coalesce(t.lo, 0) AS lo, coalesce(t.hi, 0) AS hi FROM (SELECT DISTINCT idx, label FROM cen) i JOIN (
""" + "\n UNION ALL ".join(f"SELECT idx, {t} AS channel, a.w AS lo, b.w AS hi FROM (SELECT DISTINCT idx FROM cen) LEFT JOIN t{t}lo a USING (idx) LEFT JOIN t{t}hi b USING (idx)" for t in range(4)) + """
 UNION ALL SELECT idx, 4, lo, hi FROM patch_event) t ON t.idx = i.idx
)"""
BANKS = """,
stored AS (
  SELECT label, slot % 4 AS expert, channel, lo, hi FROM (
    SELECT f.label, f.channel, f.lo, f.hi, k.slot FROM feats f JOIN (
      SELECT idx, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS slot FROM (SELECT DISTINCT idx, label FROM cen) WHERE idx % 5 <> 0
    ) k ON k.idx = f.idx WHERE k.slot < 256
  )
),
by_channel AS (
  SELECT a.idx, a.label AS actual, p.label, p.expert, a.channel, CAST(max(""" + IOU + """) AS FLOAT) AS s
  FROM feats a JOIN stored p USING (channel) WHERE a.idx % 5 = 0 GROUP BY ALL
),
wide AS (
  SELECT idx, actual, label, expert, max(s) FILTER (channel = 0) AS c0, max(s) FILTER (channel = 1) AS c1, max(s) FILTER (channel = 2) AS c2, max(s) FILTER (channel = 3) AS c3, max(s) FILTER (channel = 4) AS c4
  FROM by_channel GROUP BY ALL
),
experts AS (
  SELECT idx, actual, label, expert,
         (((c0 + c1) + c2) + c3 + CAST(0.5 AS FLOAT) * c4) / CAST(4.5 AS FLOAT) AS score FROM wide
)"""

MICRO = lambda c: f"CAST(round(CAST({c} AS DOUBLE) * 1000000) AS BIGINT)"
I = lambda c, as_: f"CAST({c} AS INTEGER) AS {as_}"  # noqa: E731, E741

ORACLES: dict[str, str] = {
    "confusion": MATCHED + f" SELECT {I('actual', 'actual')}, {I('predicted', 'predicted')}, count(*) AS n FROM best GROUP BY ALL",
    "top_class": MATCHED + f" SELECT idx, {I('actual', 'actual')}, {I('predicted', 'predicted')}, {MICRO('score')} AS score_e6 FROM best",
    "class_scores": MATCHED + f" SELECT idx, {I('label', 'label')}, {MICRO('score')} AS score_e6 FROM scored",
    "evaluation": MATCHED + " SELECT CAST(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, round(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM best",
    "evaluation_by_class": MATCHED + f" SELECT {I('actual', 'actual')}, CAST(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM best GROUP BY ALL",
    "full_confusion": MATCHED + f" SELECT {I('a.k', 'actual')}, {I('b.k', 'predicted')}, count(best.idx) AS n FROM (SELECT unnest(range(10)) AS k) a CROSS JOIN (SELECT unnest(range(10)) AS k) b LEFT JOIN best ON best.actual = a.k AND best.predicted = b.k GROUP BY a.k, b.k",
    "accuracy_gate": MATCHED + " , e AS (SELECT sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS accuracy FROM best) SELECT floor_text, NOT (accuracy < CAST(CAST(floor_text AS FLOAT) AS DOUBLE)) AS passed FROM e, (VALUES ('0.05'), ('0.85')) AS t(floor_text)",
    "encode_images": EVENTS + " SELECT idx, lo, hi FROM ev",
    "encode_images_batch": EVENTS + " SELECT idx, lo, hi FROM ev",
    "prototypes": EVENTS + MEMORY + f" SELECT {I('label', 'label')}, {I('slot', 'slot')}, lo, hi FROM protos",
    "image_mean": "WITH " + PIXELS + " SELECT idx, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS pixels, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*) * 1000) AS BIGINT) AS mean_e3 FROM pix GROUP BY idx",
    "cell_sums": "WITH " + PIXELS + f" SELECT idx, {I(CELL, 'cell')}, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM pix GROUP BY ALL",
    "ink_box": "WITH " + PIXELS + "," + moved("pix", 8, 100) + f" SELECT idx, {I('t', 'top')}, {I('b', 'bottom')}, {I('l', 'left')}, {I('x', 'right')}, {I('down', 'down')}, {I('across', 'across')} FROM shift_cen",
    "centered_pixels": "WITH " + PIXELS + "," + moved("pix", 8, 100) + f" SELECT idx, {I('r', 'r')}, {I('c', 'c')}, {I('v', 'v')} FROM cen WHERE v <> 0",
    "augmented": "WITH " + PIXELS + ", per AS (SELECT p.idx, p.label, r, c, v, e.epoch, (p.idx + e.epoch) % 5 AS turn FROM pix p, (SELECT unnest(range(2)) AS epoch) e)"
    + ", keyed AS (SELECT idx * 2 + epoch AS idx, label, r, c, v, turn FROM per),"
    + moved("keyed", 8, 100)
    + f", dd AS (SELECT DISTINCT idx, turn FROM keyed), out AS (SELECT h.idx, h.down + CASE WHEN t IS NULL THEN 0 WHEN turn = 3 THEN -1 WHEN turn = 4 THEN 1 ELSE 0 END AS down, h.across + CASE WHEN t IS NULL THEN 0 WHEN turn = 1 THEN -1 WHEN turn = 2 THEN 1 ELSE 0 END AS across FROM shift_cen h JOIN dd USING (idx)) SELECT CAST(idx // 2 AS BIGINT) AS idx, CAST(idx % 2 AS INTEGER) AS epoch, {I('down', 'down')}, {I('across', 'across')} FROM out",
    "detector_bank": "WITH " + BANK + f" SELECT {I('d', 'detector')}, {I('slot', 'slot')}, lo, hi FROM bank",
    "tiles": FEATURES + f" SELECT idx, {I('channel', 'channel')}, lo, hi FROM feats WHERE channel < 4",
    "patches": FEATURES + f" SELECT idx, {I('patch', 'patch')}, lo, hi FROM lit",
    "features": FEATURES + f" SELECT idx, {I('channel', 'channel')}, lo, hi FROM feats",
    "features_batch": FEATURES + f" SELECT idx, {I('channel', 'channel')}, lo, hi FROM feats",
    "channel_scores": FEATURES + BANKS + f" SELECT idx, {I('label', 'label')}, {I('expert', 'expert')}, {I('channel', 'channel')}, {MICRO('s')} AS score_e6 FROM by_channel",
    "expert_scores": FEATURES + BANKS + f" SELECT idx, {I('label', 'label')}, {I('expert', 'expert')}, {MICRO('score')} AS score_e6 FROM experts",
    "top_expert": FEATURES + BANKS + f" SELECT idx, {I('label', 'label')}, {I('expert', 'expert')}, {MICRO('score')} AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY idx, label ORDER BY score DESC, expert) AS k FROM experts) WHERE k = 1",
    "top_class_and_expert": FEATURES + BANKS + f" SELECT idx, {I('label', 'predicted')}, {I('expert', 'expert')}, {MICRO('score')} AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, label, expert) AS k FROM experts) WHERE k = 1",
    "splits": "SELECT name, CAST(classes AS INTEGER) AS class_count, CAST(first_label AS INTEGER) AS label_offset FROM (VALUES ('byclass', 62, 0), ('bymerge', 47, 0), ('balanced', 47, 0), ('letters', 26, 1), ('digits', 10, 0), ('mnist', 10, 0)) AS t(name, classes, first_label)",
    "label_index": f"SELECT vec_id AS idx, {I('label', 'class_index')}, {I('label + 1', 'public_label')} FROM embeddings",
    "first_rows": f"SELECT vec_id AS idx, {I('label', 'label')} FROM embeddings WHERE vec_id < 100",
    "hard_negative_rows": f"SELECT vec_id AS idx, {I('label', 'label')} FROM embeddings WHERE vec_id % 16 = 0",
    "label_confusion": "SELECT a.k AS actual, b.k AS predicted, count(l.doc_id) AS n FROM (SELECT CAST(unnest(range(2)) AS INTEGER) AS k) a CROSS JOIN (SELECT CAST(unnest(range(2)) AS INTEGER) AS k) b LEFT JOIN labels l ON l.quality = a.k AND l.toxic = b.k GROUP BY ALL",
    "idx_scan": "WITH " + PIXELS + f" SELECT idx, {I('label', 'label')}, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (r * 8 + c)) AS BIGINT) AS moment FROM pix GROUP BY idx, label",
    "rate_encode": "WITH " + PIXELS + f", steps AS (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS step) SELECT idx, step, CAST(sum(v * step // 255 - v * (step - 1) // 255) AS BIGINT) AS spikes FROM pix, steps GROUP BY idx, step",
    "sweep": " UNION ALL ".join(
        "SELECT * FROM (WITH " + PIXELS + "," + events(f"CAST(CAST({m} AS FLOAT) AS DOUBLE)") + MEMORY.replace("slot < 256", f"slot < {cap}")
        + f", scored AS (SELECT a.idx, a.label AS actual, p.label, max({IOU}) AS score FROM ev a, protos p WHERE a.idx % 5 = 0 GROUP BY ALL), best AS (SELECT actual, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, label) AS k FROM scored) WHERE k = 1) SELECT '{m}' AS multiplier, {cap} AS capacity, CAST(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM best)"
        for m in ("1.0", "1.3") for cap in (8, 256)
    ),
}
