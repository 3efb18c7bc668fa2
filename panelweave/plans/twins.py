"""Building blocks of the SQL twins: named CTEs put together on demand."""

from __future__ import annotations

HORIZON = 12

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], body: str) -> None:
    _CTES[name] = (needs, body)


def twin(names: str, body: str) -> str:
    """``WITH`` the named CTEs and whatever they need, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names.split():
        visit(name)
    parts = ", ".join(f"{n} AS ({_CTES[n][1]})" for n in ordered)
    return f"WITH {parts} {body}"


_BY_PART = """SELECT {c} AS id, date_trunc('month', l_shipdate)::DATE AS date,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
_cte("pm", (), _BY_PART.format(c="p_brand"))
_cte("pt", (), _BY_PART.format(c="p_type"))
_cte("ps", (), """SELECT l_suppkey::VARCHAR AS id, date_trunc('month', l_shipdate)::DATE AS date,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY 1, 2""")
_cte("pd", (), """SELECT user_id::VARCHAR AS id, ts::DATE AS date,
  sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events GROUP BY 1, 2""")


def _regular(panel: str, unit: str) -> None:
    _cte(f"{panel}_pad", (panel,), f"""
  SELECT c.id, c.date, p.value, p.id IS NULL AS is_padded,
    row_number() OVER (PARTITION BY c.id ORDER BY c.date) AS pos
  FROM (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 {unit}))::DATE AS date
        FROM {panel} GROUP BY id) c LEFT JOIN {panel} p ON p.id = c.id AND p.date = c.date""")
    _cte(f"{panel}_ends", (f"{panel}_pad",), f"""
  SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS lp,
    min(CASE WHEN value IS NOT NULL THEN pos END)
      OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp
  FROM {panel}_pad""")
    _cte(f"{panel}_full", (f"{panel}_ends",), f"""
  SELECT e.id, e.date, CASE WHEN e.value IS NOT NULL THEN e.value WHEN l.value IS NULL THEN r.value
      WHEN r.value IS NULL THEN l.value
      ELSE l.value + (r.value - l.value) * ((e.pos - e.lp)::DOUBLE / (e.rp - e.lp)::DOUBLE) END AS value,
    e.is_padded, e.value IS NULL AS is_imputed, e.pos
  FROM {panel}_ends e LEFT JOIN {panel}_pad l ON l.id = e.id AND l.pos = e.lp
  LEFT JOIN {panel}_pad r ON r.id = e.id AND r.pos = e.rp""")


for _p, _u in (("pm", "MONTH"), ("pt", "MONTH"), ("ps", "MONTH"), ("pd", "DAY")):
    _regular(_p, _u)


def _holdout(panel: str, h: int) -> None:
    _cte(f"{panel}_cut", (f"{panel}_full",), f"""
  SELECT min(date) AS cut FROM (SELECT DISTINCT date FROM {panel}_full ORDER BY date DESC LIMIT {h})""")
    _cte(f"{panel}_train", (f"{panel}_cut",), f"""
  SELECT id, date, value FROM {panel}_full WHERE date < (SELECT cut FROM {panel}_cut)""")
    _cte(f"{panel}_test", (f"{panel}_cut",), f"""
  SELECT id, date, value FROM {panel}_full WHERE date >= (SELECT cut FROM {panel}_cut)""")


for _p in ("pm", "pt", "ps"):
    _holdout(_p, HORIZON)
_holdout("pd", 7)

_cte("ps_scale", ("ps_train",), """
  SELECT date_diff('day', DATE '1970-01-01', date) * 86400 AS idx, year(date) AS yr FROM ps_train""")
_cte("steps", (), f"SELECT unnest(range(1, {HORIZON + 1})) AS step")


def baseline_sql(source: str, windows: tuple[int, ...], season: int | None, key: str = "id") -> str:
    """Rolling means and seasonal naive from a ``tail`` relation with ``rn`` and ``last_date``."""
    parts = [
        f"""SELECT {key}, 'rolling_mean_{n}' AS model_id, step, (last_date + to_months(step::INTEGER))::DATE AS date, prediction
  FROM (SELECT {key}, max(last_date) AS last_date, avg(value) AS prediction FROM {source} WHERE rn <= {n} GROUP BY {key})
  CROSS JOIN steps"""
        for n in windows
    ]
    if season:
        parts.append(f"""SELECT {key}, 'seasonal_naive_{season}' AS model_id, step,
  (last_date + to_months(step::INTEGER))::DATE AS date, value AS prediction
  FROM {source} JOIN steps ON rn = {season} - (step - 1) % {season} WHERE n_rows >= {season}""")
    return " UNION ALL ".join(parts)


for _p in ("pm", "pt", "ps"):
    _cte(f"{_p}_tail", (f"{_p}_train",), f"""
  SELECT id, date, value, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn,
    max(date) OVER (PARTITION BY id) AS last_date, count(*) OVER (PARTITION BY id) AS n_rows FROM {_p}_train""")
    _cte(f"{_p}_fc", (f"{_p}_tail", "steps"), baseline_sql(f"{_p}_tail", (3, 6, 12, 24), 12))
    _cte(f"{_p}_cal", (f"{_p}_fc", f"{_p}_test"), f"""
  SELECT f.model_id, f.id, f.date, f.step, t.value AS actual, f.prediction, t.value - f.prediction AS residual
  FROM {_p}_fc f JOIN {_p}_test t ON t.id = f.id AND t.date = f.date""")


def accuracy_sql(cal: str, by_id: bool) -> str:
    """The six metrics over a calibrated relation."""
    group = "model_id, id" if by_id else "model_id"
    main = f"""SELECT {group}, avg(abs(actual - prediction)) AS mae,
    100 * avg(abs((actual - prediction) / nullif(actual, 0))) AS mape,
    100 * avg(abs(actual - prediction) / nullif((abs(actual) + abs(prediction)) / 2, 0)) AS smape,
    sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
    CASE WHEN var_pop(actual) > 0 AND var_pop(prediction) > 0 THEN power(corr(actual, prediction), 2) END AS rsq,
    count(*) AS n, count(*) FILTER (WHERE actual = 0) AS n_zero_actual FROM {cal} GROUP BY {group}"""
    naive = f"""SELECT model_id, id, avg(abs(actual - prediction)) / nullif(avg(d), 0) AS mase FROM
    (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY model_id, id ORDER BY date)) AS d FROM {cal})
    GROUP BY model_id, id"""
    if by_id:
        return f"SELECT m.*, s.mase FROM ({main}) m JOIN ({naive}) s ON s.model_id = m.model_id AND s.id = m.id"
    return f"""SELECT m.*, s.mase FROM ({main}) m JOIN
    (SELECT model_id, avg(mase) AS mase FROM ({naive}) GROUP BY model_id) s ON s.model_id = m.model_id"""


for _p in ("pm", "pt", "ps"):
    _cte(f"{_p}_acc", (f"{_p}_cal",), accuracy_sql(f"{_p}_cal", False))
    _cte(f"{_p}_acc_id", (f"{_p}_cal",), accuracy_sql(f"{_p}_cal", True))
