"""Building blocks for the SQL twins of neighbourhood operators."""

from __future__ import annotations


def _map(i: str, last: str, border: str) -> str:
    if border == "reflect":
        return f"CASE WHEN {i}<0 THEN -1-({i}) WHEN {i}>{last} THEN 2*{last}+1-({i}) ELSE {i} END"
    if border == "mirror":
        return f"CASE WHEN {i}<0 THEN -({i}) WHEN {i}>{last} THEN 2*{last}-({i}) ELSE {i} END"
    if border == "nearest":
        return f"least(greatest({i}, 0), {last})"
    return i


def _on(keys: str) -> tuple[str, str]:
    ks = [k.strip() for k in keys.split(",")]
    return ", ".join(f"a.{k}" for k in ks), " AND ".join(f"b.{k}=a.{k}" for k in ks)


def line(name: str, src: str, axis: str, weights, border: str, val="v", out="v", keys="image_id") -> str:
    """Weighted sum along one axis."""
    sel, on = _on(keys)
    o = "x" if axis == "y" else "y"
    r = len(weights) // 2
    vals = ",".join(f"({k - r},{float(w)!r}::DOUBLE)" for k, w in enumerate(weights) if w != 0)
    m = _map(f"(a.{axis}+t.d)", "a.l_", border)
    return (
        f"{name}_s AS MATERIALIZED (SELECT a.*, t.w AS w_, {m} AS n_ FROM (SELECT *, max({axis}) OVER (PARTITION BY {keys}) AS l_ FROM {src}) a CROSS JOIN (VALUES {vals}) t(d, w)), "
        f"{name} AS (SELECT {sel}, a.y, a.x, sum(a.w_*b.{val}) AS {out} FROM {name}_s a JOIN {src} b ON {on} AND b.{o}=a.{o} AND b.{axis}=a.n_ GROUP BY ALL)"
    )


def gauss(name: str, src: str, sigma: float, border: str, val="v", out="v", keys="image_id", wy=None, wx=None) -> str:
    from gridloom.functions.stencil import gaussian_weights

    wy = wy or gaussian_weights(sigma)
    wx = wx or gaussian_weights(sigma)
    return line(f"{name}_r", src, "y", wy, border, val, out, keys) + ", " + line(name, f"{name}_r", "x", wx, border, out, out, keys)


def conv(name: str, src: str, kernels: dict, border: str, val="v", keys="image_id") -> str:
    """Weighted sums over a 2-D window, one output per kernel."""
    sel, on = _on(keys)
    r = max(len(k) for k in kernels.values()) // 2
    rows = []
    for j in range(-r, r + 1):
        for i in range(-r, r + 1):
            ws = []
            for k in kernels.values():
                q = len(k) // 2
                ws.append(float(k[j + q][i + q]) if abs(j) <= q and abs(i) <= q else 0.0)
            if any(ws):
                rows.append(f"({j},{i},{','.join(f'{w!r}::DOUBLE' for w in ws)})")
    names = [f"w{n}" for n in range(len(kernels))]
    outs = ", ".join(f"sum(a.{n}*b.{val}) AS {o}" for n, o in zip(names, kernels))
    return (
        f"{name}_s AS MATERIALIZED (SELECT a.*, {', '.join('t.' + n for n in names)}, {_map('(a.y+t.dy)', 'a.ly_', border)} AS ny_, {_map('(a.x+t.dx)', 'a.lx_', border)} AS nx_ "
        f"FROM (SELECT *, max(y) OVER (PARTITION BY {keys}) AS ly_, max(x) OVER (PARTITION BY {keys}) AS lx_ FROM {src}) a CROSS JOIN (VALUES {','.join(rows)}) t(dy, dx, {', '.join(names)})), "
        f"{name} AS (SELECT {sel}, a.y, a.x, {outs} FROM {name}_s a JOIN {src} b ON {on} AND b.y=a.ny_ AND b.x=a.nx_ GROUP BY ALL)"
    )


def window(name: str, src: str, r: int, border: str, expr: str, val="v", keys="image_id", disc: bool = False) -> str:
    """Any aggregate expression over the window: b.<val> is the neighbour, a.<val> the centre."""
    sel, on = _on(keys)
    offs = ",".join(f"({j},{i})" for j in range(-r, r + 1) for i in range(-r, r + 1) if not disc or i * i + j * j <= r * r)
    expr = expr.replace("t.d", "a.d")
    return (
        f"{name}_s AS MATERIALIZED (SELECT a.*, t.dy, t.dx, {_map('(a.y+t.dy)', 'a.ly_', border)} AS ny_, {_map('(a.x+t.dx)', 'a.lx_', border)} AS nx_ "
        f"FROM (SELECT *, max(y) OVER (PARTITION BY {keys}) AS ly_, max(x) OVER (PARTITION BY {keys}) AS lx_ FROM {src}) a CROSS JOIN (VALUES {offs}) t(dy, dx)), "
        f"{name} AS (SELECT {sel}, a.y, a.x, {expr} FROM {name}_s a JOIN {src} b ON {on} AND b.y=a.ny_ AND b.x=a.nx_ GROUP BY {sel}, a.y, a.x)"
    )


def otsu8(name: str, src: str, val: str, key: str = "image_id") -> str:
    """Otsu on integers 0..255, ending in `name`(key, t)."""
    return f"""{name}_h AS (SELECT {key}, {val} AS b, count(*) AS n FROM {src} GROUP BY 1,2),
{name}_c AS (SELECT *, sum(n) OVER w AS n1, sum(n*b) OVER w AS s1, sum(n) OVER t AS nt, sum(n*b) OVER t AS st FROM {name}_h WINDOW w AS (PARTITION BY {key} ORDER BY b), t AS (PARTITION BY {key})),
{name}_b AS (SELECT *, CASE WHEN nt>n1 THEN round(n1::DOUBLE/nt*((nt-n1)::DOUBLE/nt)*pow(s1::DOUBLE/n1-(st-s1)::DOUBLE/(nt-n1), 2), 4) ELSE -1 END AS bt FROM {name}_c),
{name} AS (SELECT {key}, b AS t FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY bt DESC, b) AS rn FROM {name}_b) WHERE rn=1)"""
