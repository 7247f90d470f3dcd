"""DuckDB SQL for tails and quantiles of t, F, chi-square and the normal, by Simpson's rule on smooth forms of their densities.

The operators take incomplete beta and gamma functions by continued fractions (``functions.dist``); the oracles integrate, so the two share no formula.
"""

from __future__ import annotations


def simpson(f: str, low: str, high: str, panels: int = 1000) -> str:
    """The integral of ``f``, an expression in u; ``low`` and ``high`` are expressions in columns."""
    step = f"(({high}) - ({low})) / {panels}.0"
    points = f"[(CASE WHEN k = 0 OR k = {panels} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('{u}', f'(({low}) + k * {step})')}) FOR k IN range(0, {panels + 1})]"
    return f"(list_sum({points}) * {step} / 3)"


def _t_scale(df: str) -> str:
    return f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"


def t_two_sided(t: str, df: str, panels: int = 1000) -> str:
    """P(|T| > t): T is sqrt(df) tan(u), and u has the density cos(u)^(df - 1) up to its scale; beyond 40 widths nothing is left."""
    return f"(1 - 2 * {_t_scale(df)} * {simpson(f'cos({{u}}) ** (({df}) - 1)', '0', f'least(atan(abs({t}) / sqrt({df})), 40 / sqrt({df}))', panels)})"


def f_two_sided(f: str, d1: str, d2: str) -> str:
    """Twice the smaller tail: with sin(u)^2 = d1 f / (d1 f + d2), u has the density sin(u)^(d1 - 1) cos(u)^(d2 - 1) up to its scale."""
    # the scale inside the integral, so that neither factor under- or overflows
    log = f"lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)"
    density = f"CASE WHEN {{u}} <= 0 THEN 0 ELSE 2 * exp({log} + (({d1}) - 1) * ln(sin({{u}})) + (({d2}) - 1) * ln(cos({{u}}))) END"
    low = simpson(density, "0", f"atan(sqrt(({d1}) * ({f}) / ({d2})))", 2000)
    return f"least(1.0, 2 * least({low}, 1 - {low}))"


def normal_two_sided(z: str) -> str:
    return f"(1 - sqrt(2 / pi()) * {simpson('exp(({u}) ** 2 / -2)', '0', f'least(40.0, abs({z}))')})"


def t_quantiles(name: str, source: str, p: float = 0.975) -> str:
    """A recursive CTE body ``name``(df, t) of the quantile for each df of ``source`` (p above a half): Newton from 0, which stays below it as the distribution is concave there."""
    tail = f"(1 - {t_two_sided('t', 'df', 400)} / 2)"
    density = f"({_t_scale('df')} / sqrt(df) * (1 + t * t / df) ** (-(df + 1) / 2.0))"
    return f"""{name}_steps(df, t, step) AS (SELECT df, CAST(0 AS DOUBLE), 0 FROM {source} UNION ALL SELECT df, t + ({p} - {tail}) / {density}, step + 1 FROM {name}_steps WHERE step < 40),
  {name} AS (SELECT df, t FROM {name}_steps WHERE step = 40)"""


def chi2_quantiles(name: str, source: str, p: float) -> str:
    """A recursive CTE body ``name``(df, x): the root of chi-square has a smooth density, and its quantile is bisected."""
    start = "greatest(0.0, sqrt(df) - 9)"
    density = "CASE WHEN {u} <= 0 THEN CASE WHEN df = 1 THEN sqrt(2 / pi()) ELSE 0 END ELSE exp((1 - df / 2.0) * ln(2.0) - lgamma(df / 2.0) + (df - 1) * ln({u}) - ({u}) ** 2 / 2) END"
    below = f"{simpson(density, start, '(low + high) / 2', 800)} < {p}"
    return f"""{name}_steps(df, low, high, step) AS (SELECT df, {start}, sqrt(df) + 9, 0 FROM {source} UNION ALL
   SELECT df, CASE WHEN {below} THEN (low + high) / 2 ELSE low END, CASE WHEN {below} THEN high ELSE (low + high) / 2 END, step + 1 FROM {name}_steps WHERE step < 46),
  {name} AS (SELECT df, ((low + high) / 2) ** 2 AS x FROM {name}_steps WHERE step = 46)"""
