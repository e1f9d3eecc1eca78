"""SQL twins of the greedy matches: a recursive walk over each island."""

from __future__ import annotations

_INTER = "greatest(least(g.e, p.e) - greatest(g.s, p.s), 0)"
IOU = f"CASE WHEN (g.e - g.s) + (p.e - p.s) - {_INTER} > 0 THEN {_INTER}::DOUBLE / ((g.e - g.s) + (p.e - p.s) - {_INTER}) ELSE 0.0 END"
COVER = f"CASE WHEN g.e - g.s > 0 THEN {_INTER}::DOUBLE / (g.e - g.s) ELSE 0.0 END"
_FREE = "NOT list_contains(used, g.ord)"


def _first(cond: str) -> str:
    return (
        "list_transform(list_filter(gts, lambda g: "
        f"{_FREE} AND least(g.e, p.e) > greatest(g.s, p.s) AND {cond}), "
        "lambda g: {'ord': g.ord, 'score': 1.0::DOUBLE, 't': g.t})[1]"
    )


def _best(score: str, cond: str) -> str:
    return (
        f"list_reverse_sort(list_transform(list_filter(gts, lambda g: {_FREE} AND {cond}), "
        f"lambda g: {{'score': {score}, 'neg': -g.ord, 't': g.t}}))[1]"
    )


TYPED = _first("g.t = p.t")
ANY = _first("TRUE")
BEST_IOU = _best(IOU, f"({IOU}) > 0")
BEST_COVER = _best(COVER, f"g.t = p.t AND ({COVER}) > 0.5")


def walk(choose: str, consume: str = "TRUE", best: bool = False) -> str:
    """doc_id, pred, gt, score, used - one row per prediction or missed gold."""
    pick_ord = "-pick.neg" if best else "pick.ord"
    return f"""
    WITH RECURSIVE u AS (
      SELECT doc_id, 0 AS side, ord, s, e, claim_type AS t FROM f_gt
      UNION ALL SELECT doc_id, 1, ord, s, e, claim_type FROM f_pred),
    cut AS (
      SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e, side, ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens FROM u),
    isl AS (
      SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e, side, ord ROWS UNBOUNDED PRECEDING) AS island FROM cut),
    packed AS (
      SELECT doc_id, island,
             coalesce(list({{'ord': ord, 's': s, 'e': e, 't': t}} ORDER BY ord) FILTER (side = 0), []) AS gts,
             coalesce(list({{'ord': ord, 's': s, 'e': e, 't': t}} ORDER BY ord) FILTER (side = 1), []) AS preds
      FROM isl GROUP BY doc_id, island),
    fold AS (
      SELECT doc_id, island, 0 AS i, gts, preds, []::INTEGER[] AS used,
             NULL::INTEGER AS pred, NULL::INTEGER AS gt, NULL::DOUBLE AS score, FALSE AS took FROM packed
      UNION ALL
      SELECT doc_id, island, i + 1, gts, preds,
             CASE WHEN pick IS NOT NULL AND ({consume}) THEN list_append(used, {pick_ord}) ELSE used END,
             p.ord, CASE WHEN pick IS NOT NULL THEN {pick_ord} END, pick.score,
             coalesce(pick IS NOT NULL AND ({consume}), FALSE)
      FROM (SELECT *, {choose} AS pick FROM (SELECT *, preds[i + 1] AS p FROM fold WHERE i < len(preds))))
    SELECT doc_id, pred, gt, score, took AS used FROM fold WHERE i > 0
    UNION ALL
    SELECT doc_id, NULL, g.ord, NULL, FALSE FROM (
      SELECT doc_id, used, unnest(gts) AS g FROM fold WHERE i = len(preds))
    WHERE NOT list_contains(used, g.ord)
    """


MATCH_VIEWS = {
    "m_typed": walk(TYPED),
    "m_any": walk(ANY),
    "m_iou": walk(BEST_IOU, best=True),
    "m_flex": walk(BEST_IOU, consume="pick.score >= 0.3 AND pick.t = p.t", best=True),
    "m_cover": walk(BEST_COVER, best=True),
}
