"""DuckDB SQL of the queries in ``fitting``."""

from __future__ import annotations

from quantloom.plans import oracle as base
from quantloom.plans.oracle import BARS, FEAT, FEATURES, LABELLED, r, stages

_ROWS = f"ok AS (SELECT market, date, symbol, label, {', '.join(FEATURES)} FROM lab WHERE label IS NOT NULL)"


def _day(sql: str) -> str:
    return f"SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM ({sql})"


def _soft(g: str) -> str:
    return f"(sign({g}) * greatest(abs({g}) - 0.05, 0))"


def _strength(g: str, h: str) -> str:
    return f"(greatest(abs({g}) - 0.05, 0) ** 2 / ({h} + 1.0))"


_WORDS = r"""tk AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}'']+|[.,;:!?\n]') AS ts FROM documents),
  ps AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tk),
  fl AS (SELECT *, t IN ('.', ',', ';', ':', '!', '?', chr(10)) AS stop, t = 'ion' OR t LIKE '%n''t' AS turn FROM ps),
  lg AS (SELECT *, lag(t) OVER o AS t1, lag(stop, 1) OVER o AS s1, lag(stop, 2) OVER o AS s2, lag(turn, 1) OVER o AS n1, lag(turn, 2) OVER o AS n2, lag(turn, 3) OVER o AS n3
    FROM fl WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  sc AS (SELECT doc_id, CASE WHEN coalesce(n1, false) OR (NOT coalesce(s1, true) AND (coalesce(n2, false) OR (NOT coalesce(s2, true) AND coalesce(n3, false)))) THEN 'not_' || t ELSE t END AS word,
    CASE t1 WHEN 'the' THEN 3 WHEN 'and' THEN 1 ELSE 2 END AS weight FROM lg WHERE NOT stop AND NOT turn AND t NOT IN ('the', 'and')),
  wd AS (SELECT doc_id, word, sum(weight)::BIGINT AS weight FROM sc GROUP BY doc_id, word),
  cl AS (SELECT doc_id, quality = 1 AS positive FROM labels WHERE quality IS NOT NULL),
  ct AS (SELECT word, sum(CASE WHEN positive THEN weight ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN positive THEN 0 ELSE weight END)::BIGINT AS neg FROM wd JOIN cl USING (doc_id) GROUP BY word)"""


def oracle_sql() -> dict[str, str]:
    lab = stages(FEAT, LABELLED, _ROWS)
    gradients = f"""WITH {lab},
      gr AS (SELECT *, least(4, floor({base.pct('label', 'market, date')} * 5))::DOUBLE AS rel FROM ok),
      od AS (SELECT *, row_number() OVER (PARTITION BY market, date ORDER BY symbol) AS k, row_number() OVER (PARTITION BY market, date ORDER BY rel DESC, symbol) AS b FROM gr),
      dc AS (SELECT market, date, sum(CASE WHEN b <= 30 THEN (2 ** rel - 1) / log2(b + 1) ELSE 0 END) AS ideal FROM od GROUP BY market, date),
      pr AS (SELECT x.market, x.date, x.symbol, sign(y.rel - x.rel) * 0.5 * w AS g, 0.25 * w AS h
        FROM (SELECT *, 2 ** rel AS e, 1 / log2(k + 1) AS c FROM od) x
        JOIN (SELECT market, date, k, rel, 2 ** rel AS e, 1 / log2(k + 1) AS c FROM od) y ON x.market = y.market AND x.date = y.date AND x.k != y.k AND x.rel != y.rel AND least(x.k, y.k) <= 30
        JOIN dc ON dc.market = x.market AND dc.date = x.date, LATERAL (SELECT abs(x.e - y.e) * abs(x.c - y.c) / ideal AS w)),
      sm AS (SELECT market, date, symbol, sum(g) AS g, sum(h) AS h FROM pr GROUP BY ALL)
      SELECT market, date, symbol, rel, {r('coalesce(g, 0)')} AS g, {r('coalesce(h, 0)')} AS h FROM od LEFT JOIN sm USING (market, date, symbol)"""
    features = ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES))
    stump = f"""WITH {lab},
      un AS (SELECT label, name, value FROM (UNPIVOT ok ON {', '.join(FEATURES)} INTO NAME name VALUE value)),
      st AS (SELECT name, avg(value) AS m, stddev_pop(value) AS s FROM un GROUP BY name),
      cu AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY k) AS kth, round(m + k * 0.2 * s, 9) AS cut FROM st, (SELECT unnest(range(-15, 16)) AS k) WHERE s > 0),
      li AS (SELECT name, list(cut ORDER BY kth) AS cuts FROM cu GROUP BY name),
      bi AS (SELECT name, 1 + len(list_filter(cuts, lambda c: c < value)) AS bin, label FROM un JOIN li USING (name)),
      hi AS (SELECT name, bin, sum(-label) AS g, count(*)::DOUBLE AS h FROM bi GROUP BY name, bin),
      cs AS (SELECT name, bin, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER w AS g, sum(h) OVER w AS h FROM hi
        WINDOW o AS (PARTITION BY name ORDER BY bin), w AS (PARTITION BY name)),
      gn AS (SELECT *, {_strength('gl', 'hl')} + {_strength('(g - gl)', '(h - hl)')} - {_strength('g', 'h')} AS gain FROM cs WHERE hl >= 20 AND h - hl >= 20),
      be AS (SELECT * FROM gn JOIN (VALUES {features}) AS v(name, nth) USING (name) WHERE gain > 1e-12 ORDER BY gain DESC, nth, bin LIMIT 1),
      one AS (SELECT 1 AS node, h, be.name AS feature, cut, g FROM be JOIN cu ON cu.name = be.name AND cu.kth = bin
        UNION ALL SELECT 2, hl, NULL, NULL, gl FROM be UNION ALL SELECT 3, h - hl, NULL, NULL, g - gl FROM be)
      SELECT node::BIGINT AS node, h::BIGINT AS n, feature, {r('cut')} AS cut, {r(f"-{_soft('g')} / (h + 1.0)")} AS value FROM one"""
    wins = """ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ok)),
      wf AS (SELECT s.nth AS start, i.date, i.nth < s.nth + 104 AS past FROM ix s JOIN ix i ON i.nth >= s.nth AND i.nth < s.nth + 109 WHERE s.nth % 5 = 0 AND s.nth < s.n - 104)"""
    u, v, y = "close_ma_5_ratio", "momentum_10d", "label"
    cov = ", ".join(f"covar_pop({a}, {b}) AS {n}" for n, a, b in (("uu", u, u), ("vv", v, v), ("uv", u, v), ("uy", u, y), ("vy", v, y)))
    normal = f"""WITH {lab}, {wins},
      mo AS (SELECT start, avg({u}) AS mu, avg({v}) AS mv, avg({y}) AS my, {cov} FROM ok JOIN wf USING (date) WHERE past GROUP BY start),
      co AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b2 FROM mo)
      SELECT symbol, date, start, {r(f'my + b1 * ({u} - mu) + b2 * ({v} - mv)')} AS pred_ret FROM ok JOIN wf USING (date) JOIN co USING (start) WHERE NOT past"""
    sums = ", ".join(f"{r(f'sum({f})')} AS sum_{f}" for f in FEATURES)
    matrix = f"""WITH {lab} SELECT market, date, count(*) AS n, sum(count(*)) OVER (ORDER BY market, date)::BIGINT AS ends, {r('sum(label)')} AS sum_label, {sums} FROM ok GROUP BY market, date"""
    scores = f"""WITH {_WORDS}, wh AS (SELECT coalesce(sum(pos), 0) AS p, coalesce(sum(neg), 0) AS n, count(*) AS v FROM ct), pr AS (SELECT ln(count(*) FILTER (positive) + 1.0) - ln(count(*) FILTER (NOT positive) + 1.0) AS prior FROM cl),
      mv AS (SELECT doc_id, sum(weight * (ln((pos + 1.0) / (p + v)) - ln((neg + 1.0) / (n + v)))) / 2 AS moved FROM wd JOIN ct USING (word), wh GROUP BY doc_id),
      od AS (SELECT doc_id, text, prior + coalesce(moved, 0) AS o FROM documents LEFT JOIN mv USING (doc_id), pr),
      sd AS (SELECT doc_id, o, (exp(least(o, 700)) - 1) / (exp(least(o, 700)) + 1) AS s, greatest(-0.5, least(0.5, ({base.hits("coalesce(text, '')", base.POS)} - {base.hits("coalesce(text, '')", base.NEG)}) * 0.08)) AS m FROM od)
      SELECT doc_id, {r('o')} AS log_odds, {r('s')} AS score, {r('greatest(-1.0, least(1.0, s + m))')} AS boosted FROM sd"""
    return {"bayes_counts": f"WITH {_WORDS} SELECT * FROM ct", "bayes_scores": scores, "rank_gradients": _day(gradients), "newton_stump": stump, "wfa_normal": _day(normal), "training_matrix": _day(matrix)}
