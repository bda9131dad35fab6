"""Eigen-decomposition in plain SQL, for checks.

A matrix is a row with 64 real and 64 imaginary parts.  Its largest mode is the limit of
squaring and normalising by the trace; with the mode subtracted, the next follows.  The
matrix is shifted by its norm first, so all modes are positive and the largest comes first.
What results are projectors and eigenvalues, which have no phase to agree upon.
"""

from __future__ import annotations

N = 8
SQUARINGS = 26
CELLS = f"range({N * N})"


def cell(a: str, r: str, c: str) -> str:
    return f"{a}[{N} * ({r}) + ({c}) + 1]"


def product(xr: str, xi: str, yr: str, yi: str) -> tuple[str, str]:
    """Real and imaginary cells of a matrix product."""
    row, col = f"c // {N}", f"c % {N}"
    re = f"{cell(xr, row, 'k')} * {cell(yr, 'k', col)} - {cell(xi, row, 'k')} * {cell(yi, 'k', col)}"
    im = f"{cell(xr, row, 'k')} * {cell(yi, 'k', col)} + {cell(xi, row, 'k')} * {cell(yr, 'k', col)}"
    return tuple(f"[list_sum([{e} for k in range({N})]) for c in {CELLS}]" for e in (re, im))


def trace(a: str) -> str:
    return f"list_sum([{a}[{N + 1} * k + 1] for k in range({N})])"


def both(xr: str, xi: str, yr: str, yi: str) -> str:
    """Real part of the trace of a product of two Hermitian matrices."""
    return f"list_sum([{xr}[c + 1] * {yr}[c + 1] + {xi}[c + 1] * {yi}[c + 1] for c in {CELLS}])"


def matrices(source: str, keys: str, name: str = "mat", where: str = "true") -> str:
    """Full matrices of an upper triangle in long form: ``keys, re, im``; missing cells are 0."""
    return f"""
{name}_long AS (SELECT {keys}, {N} * i + j AS c, re, CASE WHEN i = j THEN 0 ELSE im END AS im FROM {source} WHERE {where}
  UNION ALL SELECT {keys}, {N} * j + i, re, -im FROM {source} WHERE i < j AND {where}),
{name}_map AS (SELECT {keys}, map_from_entries(list((c, re))) AS mr, map_from_entries(list((c, im))) AS mi FROM {name}_long GROUP BY ALL),
{name} AS (SELECT {keys}, [coalesce(mr[c], 0.0::DOUBLE) for c in {CELLS}] AS re, [coalesce(mi[c], 0.0::DOUBLE) for c in {CELLS}] AS im
  FROM {name}_map)"""


def modes(source: str, keys: str, count: int, name: str = "modes") -> str:
    """Largest ``count`` modes of each matrix: ``keys, mode`` (from 0), ``lam``, ``pr``, ``pi``.  Needs WITH RECURSIVE."""
    sr, si = product("br", "bi", "br", "bi")
    return f"""
{name}_start AS (SELECT {keys}, re, im, sqrt({both('re', 'im', 're', 'im')}) AS shift FROM {source}),
{name}_it AS (
  SELECT {keys}, shift, 0 AS mode, 0 AS step, ar, im AS ai, [x / greatest(t, 1e-300) for x in ar] AS br, [x / greatest(t, 1e-300) for x in im] AS bi
  FROM (SELECT *, {trace('ar')} AS t FROM (SELECT *, [re[c + 1] + CASE WHEN c % {N + 1} = 0 THEN shift ELSE 0 END for c in {CELLS}] AS ar FROM {name}_start))
  UNION ALL
  SELECT {keys}, shift, CASE WHEN step = {SQUARINGS} THEN mode + 1 ELSE mode END, CASE WHEN step = {SQUARINGS} THEN 0 ELSE step + 1 END, nr, ni,
    [x / greatest(t, 1e-300) for x in zr], [x / greatest(t, 1e-300) for x in zi]
  FROM (SELECT *, {trace('zr')} AS t FROM (
    SELECT *, CASE WHEN step = {SQUARINGS} THEN nr ELSE sr END AS zr, CASE WHEN step = {SQUARINGS} THEN ni ELSE si END AS zi FROM (
      SELECT *, CASE WHEN step = {SQUARINGS} THEN [ar[c + 1] - l * br[c + 1] for c in {CELLS}] ELSE ar END AS nr,
        CASE WHEN step = {SQUARINGS} THEN [ai[c + 1] - l * bi[c + 1] for c in {CELLS}] ELSE ai END AS ni,
        CASE WHEN step < {SQUARINGS} THEN {sr} END AS sr, CASE WHEN step < {SQUARINGS} THEN {si} END AS si
      FROM (SELECT *, {both('ar', 'ai', 'br', 'bi')} AS l FROM {name}_it WHERE mode < {count})))
  ) WHERE NOT (mode = {count - 1} AND step = {SQUARINGS})),
{name} AS (SELECT {keys}, mode, {both('ar', 'ai', 'br', 'bi')} - shift AS lam, br AS pr, bi AS pi FROM {name}_it WHERE step = {SQUARINGS})"""


def whitened(source: str = "mat", name: str = "wm") -> str:
    """Whitened p == q matrices: ``block, channel, pol, re, im`` and the diagonal's roots ``d``."""
    root = f"[sqrt(greatest(re[{N + 1} * k + 1], 1e-10)) for k in range({N})]"
    cells = lambda x: f"[{x}[c + 1] / (d[c // {N} + 1] * d[c % {N} + 1]) for c in {CELLS}]"
    return f"""
{name} AS (SELECT block, channel, p AS pol, d, {cells('re')} AS re, {cells('im')} AS im
  FROM (SELECT *, {root} AS d FROM {source} WHERE p = q))"""


def unwhitened(modes_: str = "modes", matrix: str = "wm", name: str = "um") -> str:
    """Projectors of modes scaled back by the diagonal's roots and normalised."""
    scaled = lambda x: f"[{x}[c + 1] * d[c // {N} + 1] * d[c % {N} + 1] for c in {CELLS}]"
    return f"""
{name}_raw AS (SELECT m.block, m.channel, m.pol, m.mode, m.lam, {scaled('pr')} AS sr, {scaled('pi')} AS si
  FROM {modes_} m JOIN {matrix} w ON w.block = m.block AND w.channel = m.channel AND w.pol = m.pol),
{name} AS (SELECT * EXCLUDE (sr, si), [x / t for x in sr] AS pr, [x / t for x in si] AS pi
  FROM (SELECT *, {trace('sr')} AS t FROM {name}_raw))"""


def detected(delta: float, name: str = "det") -> str:
    """Modes above median + delta * sigma of each spectrum, and the mean of the others."""
    return f"""
{name} AS (SELECT block, channel, pol, k, CASE WHEN k < {N} THEN list_sum([x for x in lams if x <= threshold]) / ({N} - k) ELSE 0 END AS noise
  FROM (SELECT *, len([x for x in lams if x > threshold]) AS k FROM (
    SELECT block, channel, pol, list(lam) AS lams,
      quantile_cont(lam, 0.5) + {delta} * (quantile_cont(lam, 0.8) - quantile_cont(lam, 0.2)) / (2.0 * 0.8416) AS threshold
    FROM modes GROUP BY ALL)))"""


def projection(terms: str, name: str = "proj") -> str:
    """I - sum of ``factor`` times projector over ``terms``: ``block, channel, pol, c, re, im`` in long form."""
    return f"""
{name} AS (SELECT block, channel, pol, c, any_value(one) - sum(factor * pr[c + 1]) AS re, -sum(factor * pi[c + 1]) AS im
  FROM ({terms}), (SELECT CAST(c AS INTEGER) AS c, CASE WHEN c % {N + 1} = 0 THEN 1 ELSE 0 END AS one FROM (SELECT unnest({CELLS}) AS c))
  GROUP BY block, channel, pol, c)"""


#: Terms of a shrink projection: detected modes by one minus the ratio of noise to eigenvalue.
SHRINK = """SELECT m.*, CASE WHEN m.mode >= d.k THEN 0 WHEN m.lam > 0 THEN 1 - d.noise / m.lam ELSE 1 END AS factor
  FROM modes m JOIN det d ON d.block = m.block AND d.channel = m.channel AND d.pol = m.pol"""
