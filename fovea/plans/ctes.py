"""DuckDB definitions of the test movies and models, for the oracle SQL."""

EMB = """emb_f AS (
  SELECT (label + 1)::INTEGER AS video_id, row_number() OVER (ORDER BY label, vec_id) AS frame, embedding FROM embeddings
), emb AS (
  SELECT video_id, frame, (p - 1)::INTEGER AS px, embedding[p]::DOUBLE AS value FROM emb_f, range(1, 65) t(p)
)"""
EMB_IMAGE = """emb_m AS (
  SELECT px, avg(value) x1, avg(value ** 2) x2, avg(value ** 3) x3, avg(value ** 4) x4 FROM emb GROUP BY px
), emb_image AS (
  SELECT px, (x3 - 3 * x1 * x2 + 2 * x1 ** 3) ** 2 / (x2 - x1 * x1) ** 3 / 12
    + ((x4 - 4 * x1 * x3 + 6 * x1 * x1 * x2 - 3 * x1 ** 4) / (x2 - x1 * x1) ** 2 - 3) / 48 AS v FROM emb_m
)"""
EV = """ev_s AS (
  SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) + 1 AS frame, (user_id % 64)::INTEGER AS px, sum(value) AS v FROM events GROUP BY ALL
), ev AS (
  SELECT ((f.frame - 1) // 240 + 1)::INTEGER AS video_id, f.frame, p.px::INTEGER AS px, coalesce(v, 0) AS value
  FROM range(1, 721) f(frame) CROSS JOIN range(64) p(px) LEFT JOIN ev_s ON ev_s.frame = f.frame AND ev_s.px = p.px
)"""
LI = """li_days AS (
  SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) AS frame FROM (SELECT DISTINCT l_shipdate FROM lineitem)
), li AS (
  SELECT (year(l_shipdate) - 1994)::INTEGER AS video_id, frame, (l_partkey % 1024)::INTEGER AS px, sum(l_quantity) AS value
  FROM lineitem JOIN li_days USING (l_shipdate) GROUP BY ALL
), li_n AS (SELECT video_id, count(DISTINCT frame) AS n FROM li GROUP BY ALL)"""
GRID = """grid AS (
  SELECT (1 + 3 * b.y + a.x)::INTEGER AS cell, (2 * a.x + c.i + 8 * (2 * b.y + d.j))::INTEGER AS px, 1.0::DOUBLE / 3 AS w
  FROM range(3) a(x), range(3) b(y), range(3) c(i), range(3) d(j)
)"""
TRACES = f"""{EV}, {GRID}, tr AS (
  SELECT video_id, frame, cell, sum(w * value) AS r, greatest(sum(w * value), 0) AS c FROM ev JOIN grid USING (px) GROUP BY ALL
)"""
MODEL = f"""{TRACES}, b0 AS (
  SELECT video_id, px, avg(value) AS m, avg(value) AS b FROM ev GROUP BY ALL
), free AS (SELECT px::INTEGER AS px FROM range(64) t(px) WHERE px NOT IN (SELECT px FROM grid)
), b1 AS (
  SELECT v.video_id::INTEGER AS video_id, px, 1 / sqrt((SELECT count(*) FROM free)) AS b FROM free, range(1, 4) v(video_id)
), rawf AS (
  SELECT video_id, frame, sum(value * b) AS raw_f FROM ev JOIN b1 USING (video_id, px) GROUP BY ALL
), dots AS (
  SELECT video_id, sum(b1.b * b0.b) AS x FROM b1 JOIN b0 USING (video_id, px) GROUP BY ALL
), f AS (
  SELECT video_id, frame, raw_f - x AS f FROM rawf JOIN dots USING (video_id)
), sf AS (SELECT video_id, sum(f) AS sf, count(*) AS len FROM f GROUP BY ALL
), e0 AS (
  SELECT video_id, px, sum(w * s) AS e FROM grid JOIN (SELECT video_id, cell, sum(c) AS s FROM tr GROUP BY ALL) USING (cell) GROUP BY ALL
), x0 AS (SELECT video_id, px, b * sf / len AS x FROM b1 JOIN sf USING (video_id)
), b0n AS (
  SELECT b0.video_id, b0.px, m, m - coalesce(e, 0) / 720 - coalesce(x, 0) AS b
  FROM b0 LEFT JOIN e0 USING (video_id, px) LEFT JOIN x0 USING (video_id, px)
), rawb AS (SELECT ev.video_id, px, sum(value * f) AS raw_b FROM ev JOIN f USING (frame) GROUP BY ALL
), cf AS (SELECT tr.video_id, cell, sum(c * f) AS s FROM tr JOIN f USING (frame) GROUP BY ALL
), e1 AS (SELECT video_id, px, sum(w * s) AS e FROM grid JOIN cf USING (cell) GROUP BY ALL
), b1u AS (
  SELECT rawb.video_id, rawb.px, raw_b - coalesce(e, 0) - b0n.b * sf AS b
  FROM rawb LEFT JOIN e1 USING (video_id, px) JOIN b0n USING (video_id, px) JOIN sf USING (video_id)
), b1n AS (SELECT video_id, px, b / sqrt(sum(b * b) OVER (PARTITION BY video_id)) AS b FROM b1u
), bs AS (SELECT px, avg(value) AS b FROM ev GROUP BY ALL)"""
FEET = f"""{GRID}, feet_m AS (SELECT (user_id % 64)::INTEGER AS px, sum(value) AS m FROM events GROUP BY ALL
), feet AS (SELECT cell, px, m / sqrt(sum(m * m) OVER (PARTITION BY cell)) AS w FROM grid JOIN feet_m USING (px))"""
SPIKES = """spike_v AS (
  SELECT c.c::INTEGER AS cell, f.f AS frame, coalesce(v, 0) AS v FROM range(1, 5) c(c) CROSS JOIN range(1, 241) f(f)
  LEFT JOIN (SELECT user_id % 4 + 1 AS cell, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // 3 + 1 AS frame, sum(value) AS v FROM events GROUP BY ALL) e ON e.cell = c.c AND e.frame = f.f
), spikes AS (
  SELECT cell, frame, greatest(0.0::DOUBLE, coalesce((v - avg(v) OVER (PARTITION BY cell)) / nullif(stddev_pop(v) OVER (PARTITION BY cell), 0), 0) - 1.2::DOUBLE) AS s FROM spike_v
)"""
CELL_MOVIE = f"""{SPIKES}, spots_w AS (
  SELECT k.k::INTEGER AS cell, p.p::INTEGER AS px, exp(-(((p % 24) - ((k - 1) % 2 + 0.5::DOUBLE) * 12) ** 2 + ((p // 24) - ((k - 1) // 2 + 0.5::DOUBLE) * 12) ** 2) / (2 * 2.5::DOUBLE * 2.5::DOUBLE)) AS w
  FROM range(1, 5) k(k), range(576) p(p)
), spots AS (SELECT cell, px, w / sqrt(sum(w * w) OVER (PARTITION BY cell)) AS w FROM spots_w WHERE w > 0.05
), decays AS (
  SELECT a.cell, a.frame, sum(b.s * 0.85::DOUBLE ** (a.frame - b.frame)) AS c FROM spikes a JOIN spikes b ON a.cell = b.cell AND b.frame BETWEEN a.frame - 60 AND a.frame GROUP BY ALL
), signals AS (SELECT frame, px, sum(w * c * 60) AS x FROM spots JOIN decays USING (cell) GROUP BY ALL
), cells_movie AS (
  SELECT ((f - 1) // 80 + 1)::INTEGER AS video_id, f AS frame, p::INTEGER AS px, coalesce(x, 0) + 10 + coalesce(8 * embedding[p % 64 + 1]::DOUBLE, 0) AS value
  FROM (SELECT f, p, (f * 9 + p // 64) % (SELECT count(*) FROM embeddings) AS vec_id FROM range(1, 241) a(f), range(576) b(p)) e
  LEFT JOIN embeddings USING (vec_id) LEFT JOIN signals ON signals.frame = e.f AND signals.px = e.p
)"""


def pools_sql(n: str, source: str) -> str:
    """Deconvolution as a recursion over samples: each step joins the last two pools or opens one for the next sample.

    ``source``: (key, gamma, x), the samples less the penalty as a list. Gives
    ``{n}_fit`` (key, frame, c, s).
    """
    joins = "len(v) > 1 AND v[-1] < gamma ** n[-2] * v[-2]"
    return f"""{n}_x AS MATERIALIZED ({source}), {n}_o AS (
  SELECT key, 0 AS t, []::DOUBLE[] AS v, []::DOUBLE[] AS w, []::BIGINT[] AS n FROM {n}_x
  UNION ALL
  SELECT key, CASE WHEN joins THEN t ELSE t + 1 END,
    CASE WHEN joins THEN list_append(v[:len(v) - 2], (w[-2] * v[-2] + d * w[-1] * v[-1]) / (w[-2] + d * d * w[-1])) ELSE list_append(v, x[t + 1]) END,
    CASE WHEN joins THEN list_append(w[:len(w) - 2], w[-2] + d * d + w[-1]) ELSE list_append(w, 1.0::DOUBLE) END,
    CASE WHEN joins THEN list_append(n[:len(n) - 2], n[-2] + n[-1]) ELSE list_append(n, 1::BIGINT) END
  FROM (SELECT o.*, x.x, {joins} AS joins, gamma ** n[-2] AS d FROM {n}_o o JOIN {n}_x x USING (key)) WHERE joins OR t < len(x)
), {n}_pools AS (
  SELECT key, gamma, unnest(v) AS v, unnest(n) AS n, unnest(range(len(v))) AS k FROM {n}_o JOIN {n}_x USING (key) WHERE t = len(x) AND NOT ({joins})
), {n}_placed AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY k) - n AS start FROM {n}_pools
), {n}_c AS (SELECT key, gamma, start, (start + a + 1)::BIGINT AS frame, greatest(v, 0) * gamma ** a AS c FROM (SELECT *, unnest(range(n)) AS a FROM {n}_placed)
), {n}_fit AS MATERIALIZED (SELECT key, frame, c, CASE WHEN frame = start + 1 AND start > 0 THEN c - gamma * lag(c) OVER (PARTITION BY key ORDER BY frame) ELSE 0 END AS s FROM {n}_c)"""


def penalised(y: str, gamma: str, lam: str) -> str:
    """The samples of list ``y`` less the penalty."""
    return f"list_transform({y}, lambda v, i: v - CASE WHEN i = len({y}) THEN {lam} ELSE {lam} * (1 - {gamma}) END)"


NOISY = f"""{SPIKES}, truth AS (
  SELECT a.cell, a.frame, max(a.s) AS s, sum(b.s * 0.9::DOUBLE ** (a.frame - b.frame)) AS c FROM spikes a JOIN spikes b ON a.cell = b.cell AND b.frame <= a.frame GROUP BY ALL
), noisy AS MATERIALIZED (
  SELECT cell, frame, t.s, t.c, t.c + 0.3::DOUBLE * coalesce(8 * embedding[(frame - 1) % 64 + 1]::DOUBLE, 0) AS y
  FROM (SELECT *, ((frame - 1) * 4 + cell) % (SELECT count(*) FROM embeddings) AS vec_id FROM truth) t LEFT JOIN embeddings USING (vec_id)
)"""
