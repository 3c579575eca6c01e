"""Common table expressions of the check queries."""

from __future__ import annotations

from gridwake.queries.registry import CHANNELS, SPEC, STEP_US, TOPICS

_W, _S, _H = SPEC.window, SPEC.stride, SPEC.horizon
_CH = ", ".join(f"('{c}', '{t}')" for c, t in sorted(TOPICS.items()))
assert set(TOPICS) == set(CHANNELS)

# name -> (names it builds on, body)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "tel": ((), "SELECT user_id AS run, event_type AS channel, epoch_us(ts) AS ts_us, value, event_id AS seq FROM events"),
    "bounds": (("tel",), "SELECT run, min(ts_us) AS start_us, max(ts_us) AS stop_us FROM tel GROUP BY run"),
    "sized": (("bounds",), f"SELECT *, (stop_us - start_us) // {STEP_US} + 1 AS rows FROM bounds"),
    "grid": (
        ("sized",),
        f"SELECT run, k, start_us + k * {STEP_US} AS ts_us, rows FROM (SELECT *, unnest(range(rows)) AS k FROM sized)",
    ),
    "chan": ((), f"SELECT * FROM (VALUES {_CH}) AS c(channel, topic)"),
    "cells": (("grid", "chan"), "SELECT run, k, ts_us, rows, channel FROM grid, chan"),
    "series_n": (("tel",), "SELECT run, channel, count(DISTINCT ts_us) AS n FROM tel GROUP BY ALL"),
    "before": (
        ("cells", "tel"),
        "SELECT c.*, t.ts_us AS t0, t.value AS v0 FROM cells c ASOF LEFT JOIN tel t"
        " ON c.run = t.run AND c.channel = t.channel AND c.ts_us >= t.ts_us",
    ),
    "around": (
        ("before", "tel", "series_n"),
        "SELECT c.*, t.ts_us AS t1, t.value AS v1, coalesce(s.n, 0) AS n FROM before c ASOF LEFT JOIN tel t"
        " ON c.run = t.run AND c.channel = t.channel AND c.ts_us < t.ts_us"
        " LEFT JOIN series_n s ON s.run = c.run AND s.channel = c.channel",
    ),
    "lin": (
        ("around",),
        "SELECT run, channel, k, ts_us, rows, n, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0"
        " ELSE v0 + (v1 - v0) * ((ts_us - t0)::DOUBLE / (t1 - t0)) END AS v FROM around",
    ),
    "aligned": (("lin",), "SELECT run, channel, k, ts_us, rows, CASE WHEN n >= 2 THEN v END AS value FROM lin"),
    "filled": (("aligned",), "SELECT run, channel, k, ts_us, rows, coalesce(value, 0.0) AS value FROM aligned"),
    "iv": (
        (),
        "SELECT user_id AS run, epoch_us(ts) AS start_us, epoch_us(ts) + 43200000000 AS end_us, event_id AS ordinal,"
        " (props->>'$.k')::BIGINT % 4 + 1 AS class_id FROM events WHERE event_type = 'error' AND value >= 100",
    ),
    "labelled": (
        ("grid", "iv"),
        "SELECT g.run, g.k, g.ts_us, g.rows, (max(i.ordinal) IS NOT NULL)::BIGINT AS label,"
        " coalesce(arg_max(i.class_id, i.ordinal), 0)::BIGINT AS class_id"
        " FROM grid g LEFT JOIN iv i ON g.run = i.run AND g.ts_us BETWEEN i.start_us AND i.end_us GROUP BY ALL",
    ),
    "wins": (
        ("sized",),
        f"SELECT run, rows, w, w * {_S} AS start_k, n_windows FROM (SELECT *, unnest(range(n_windows)) AS w FROM"
        f" (SELECT *, CASE WHEN rows - {_W + _H} < 0 THEN 0 ELSE (rows - {_W + _H}) // {_S} + 1 END AS n_windows FROM sized))",
    ),
    "wlab": (
        ("wins", "labelled"),
        f"SELECT w.run, w.w, w.start_k, w.n_windows, max(l.label) AS label FROM wins w JOIN labelled l"
        f" ON l.run = w.run AND l.k BETWEEN w.start_k AND w.start_k + {_W + _H - 1} GROUP BY ALL",
    ),
    "wcls": (
        ("wins", "labelled"),
        f"SELECT w.run, w.w, coalesce(arg_max(c.class_id, c.n * 10 - c.class_id), 0)::BIGINT AS class_id FROM wins w LEFT JOIN"
        f" (SELECT w.run, w.w, l.class_id, count(*) AS n FROM wins w JOIN labelled l ON l.run = w.run"
        f" AND l.k BETWEEN w.start_k AND w.start_k + {_W + _H - 1} WHERE l.class_id BETWEEN 1 AND 5 GROUP BY ALL) c"
        f" ON c.run = w.run AND c.w = w.w GROUP BY ALL",
    ),
    "wx": (
        ("wins", "filled"),
        f"SELECT w.run, w.w, a.channel, a.k - w.start_k AS i, a.value AS x FROM wins w JOIN filled a"
        f" ON a.run = w.run AND a.k BETWEEN w.start_k AND w.start_k + {_W - 1}",
    ),
    "wmu": (
        ("wx",),
        "SELECT *, lag(x) OVER (PARTITION BY run, channel, w ORDER BY i) AS p,"
        " lead(x) OVER (PARTITION BY run, channel, w ORDER BY i) AS nx,"
        " avg(x) OVER (PARTITION BY run, channel, w) AS mu FROM wx",
    ),
    "feat": (
        ("wmu",),
        'SELECT run, channel, w, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, max(x) - min(x) AS "range",'
        " quantile_cont(x, 0.10) AS q10, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50,"
        " quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.9) AS q90,"
        f' arg_min(x, i) AS start, arg_max(x, i) AS "end", arg_max(x, i) - arg_min(x, i) AS endpoint_delta,'
        " avg(x - p) AS diff_mean, stddev_pop(x - p) AS diff_std, avg(abs(x - p)) AS diff_abs_mean, max(abs(x - p)) AS diff_abs_max,"
        " avg((x - mu) * (p - mu)) / greatest(stddev_pop(CASE WHEN p IS NOT NULL THEN x END)"
        " * stddev_pop(CASE WHEN nx IS NOT NULL THEN x END), 1e-6) AS lag1 FROM wmu GROUP BY run, channel, w",
    ),
    "featlong": (
        ("feat",),
        "UNPIVOT feat ON mean, std, min, max, \"range\", q10, q25, q50, q75, q90, start, \"end\", endpoint_delta, diff_mean, diff_std,"
        " diff_abs_mean, diff_abs_max, lag1 INTO NAME descriptor VALUE value",
    ),
}


def _resolve(names, done: dict[str, str]) -> None:
    for name in names:
        if name not in done:
            deps, body = CTE[name]
            _resolve(deps, done)
            done[name] = body


def sql(select: str, *names: str, **extra: str) -> str:
    """WITH clause of the named expressions (and what they build on), `extra` ones, then `select`."""
    done: dict[str, str] = {}
    _resolve(names, done)
    done.update(extra)
    body = ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in done.items())
    return f"WITH {body} {select}" if body else select


def r(expr: str, name: str | None = None) -> str:
    """Rounded double, -0.0 folded."""
    out = f"round(({expr})::DOUBLE, 6) + 0.0"
    return f"{out} AS {name}" if name else out
