"""SQL that finds spectra and orthonormal polynomials by its own means, to compare decompositions with.

The library takes singular values of triangles and inverts normal equations; here a covariance matrix is squared until its
largest eigenvector stands alone and is then taken off, and polynomials come from their three-term recurrence."""

from __future__ import annotations

#: A matrix is squared this many times: vectors whose eigenvalues differ by 1 / 10,000 are told apart by a factor of exp(100).
SQUARINGS = 20


def spectra(rows: str, k: int) -> str:
    """WITH ... spectra (w, k, e, u): the first k eigenvalues and vectors, each with its farthest entry positive, of the covariance of rows (w, t, j, y).

    Also n0 (w, j, v, t, n), the centred columns in the order of t, and totals (w, total, t_start, t_end)."""
    parts = [
        f"d AS ({rows})",
        "n0 AS MATERIALIZED (SELECT w, j, list(y - m ORDER BY t) AS v, list(t ORDER BY t) AS t, count(*) AS n FROM (SELECT *, avg(y) OVER (PARTITION BY w, j) AS m FROM d) GROUP BY w, j)",
        "c1 AS MATERIALIZED (SELECT a.w, a.j AS i, list(list_dot_product(a.v, b.v) / (a.n - 1) ORDER BY b.j) AS v FROM n0 a JOIN n0 b USING (w) GROUP BY a.w, a.j)",
        "totals AS (SELECT w, total, t_start, t_end FROM (SELECT w, sum(v[i + 1]) AS total FROM c1 GROUP BY w) JOIN (SELECT w, t[1] AS t_start, t[len(t)] AS t_end FROM n0 WHERE j = 0) USING (w))",
    ]
    for c in range(1, k + 1):
        square = f"SELECT a.w, a.step, a.i, list(list_dot_product(a.v, b.v) ORDER BY b.i) AS v FROM p{c} a JOIN p{c} b USING (w) GROUP BY ALL"
        scaled = f"SELECT w, step + 1, i, list_transform(v, lambda x: x / s) FROM (SELECT *, sum(v[i + 1]) OVER (PARTITION BY w) AS s FROM ({square})) WHERE step < {SQUARINGS}"
        top = f"SELECT w, arg_max(v, v[i + 1]) AS v FROM p{c} WHERE step = {SQUARINGS} GROUP BY w"
        unit = f"SELECT w, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ({top})"
        parts += [
            f"p{c}(w, step, i, v) AS (SELECT w, 0, i, v FROM c{c} UNION ALL {scaled})",
            f"u{c} AS MATERIALIZED (SELECT w, CASE WHEN list_max(u) < -list_min(u) THEN list_transform(u, lambda x: -x) ELSE u END AS u FROM ({unit}))",
            f"e{c} AS MATERIALIZED (SELECT w, u, list_dot_product(u, list(list_dot_product(v, u) ORDER BY i)) AS e FROM c{c} JOIN u{c} USING (w) GROUP BY w, u)",
        ]
        if c < k:
            parts.append(f"c{c + 1} AS MATERIALIZED (SELECT w, i, list_transform(list_zip(v, u), lambda z: z[1] - e * u[i + 1] * z[2]) AS v FROM c{c} JOIN e{c} USING (w))")
    parts.append("spectra AS (" + " UNION ALL ".join(f"SELECT w, {c}::INT AS k, e, u FROM e{c}" for c in range(1, k + 1)) + ")")
    return "WITH RECURSIVE " + ",\n".join(parts)


def polynomials(p: int, degree: int = 5) -> str:
    """WITH ... q (x, t0 .., q0 ..), one row of arrays over p even points of [-1, 1]: polynomials that are orthogonal over the points, and the same at unit length."""
    parts = [f"t1 AS (SELECT x, list_transform(x, lambda v: 1.0::DOUBLE) AS t0, x AS t1 FROM (SELECT list_transform(range({p}), lambda i: -1 + 2.0::DOUBLE * i / {p - 1}) AS x))"]
    for n in range(2, degree + 1):
        moved = f"list_transform(list_zip(x, t{n - 1}), lambda z: z[1] * z[2])"
        ratio = f"list_dot_product(t{n - 1}, list_transform(list_zip(x, t{n - 2}), lambda z: z[1] * z[2])) / list_dot_product(t{n - 2}, t{n - 2})"
        parts.append(f"t{n} AS (SELECT *, list_transform(list_zip(m, t{n - 2}), lambda z: z[1] - b * z[2]) AS t{n} FROM (SELECT *, {moved} AS m, {ratio} AS b FROM t{n - 1}))".replace("SELECT *, list_transform", "SELECT * EXCLUDE (m, b), list_transform", 1))
    units = ", ".join(f"list_transform(t{n}, lambda v: v / sqrt(list_dot_product(t{n}, t{n}))) AS q{n}" for n in range(degree + 1))
    return "WITH " + ", ".join(parts) + f", q AS (SELECT *, {units} FROM t{degree})"


#: Legendre polynomials of v, by degree.
LEGENDRE = ("1.0::DOUBLE", "v", "(3 * v * v - 1) / 2", "(5 * v * v * v - 3 * v) / 2", "(35 * v * v * v * v - 30 * v * v + 3) / 8", "(63 * v * v * v * v * v - 70 * v * v * v + 15 * v) / 8")


def weights_sql(p: int = 64) -> str:
    """(j, degree, w): what a centred curve is multiplied by for its least-squares scores on the Legendre polynomials.

    Scores on the orthonormal polynomials are turned by substitution from the highest degree down."""
    parts = ["l AS (SELECT *, " + ", ".join(f"list_transform(x, lambda v: {f}) AS l{d}" for d, f in enumerate(LEGENDRE)) + " FROM q)"]
    before = "l"
    for d in range(5, -1, -1):
        value = f"q{d}[j]" + "".join(f" - list_dot_product(q{d}, l{i}) * w{i}[j]" for i in range(d + 1, 6))
        parts.append(f"s{d} AS (SELECT *, list_transform(range(1, {p + 1}), lambda j: ({value}) / list_dot_product(q{d}, l{d})) AS w{d} FROM {before})")
        before = f"s{d}"
    rows = " UNION ALL ".join(f"SELECT unnest(range({p}))::INT AS j, {d} AS degree, unnest(w{d}) AS w FROM s0" for d in range(6))
    return polynomials(p) + ", " + ", ".join(parts) + f" {rows}"


def smoother_sql(p: int = 64) -> str:
    """(i, j, s): the projection on polynomials up to degree 5, which turns a centred curve into its fit."""
    value = " + ".join(f"q{d}[i + 1] * q{d}[j + 1]" for d in range(6))
    return polynomials(p) + f" SELECT i::INT AS i, j::INT AS j, {value} AS s FROM q, range({p}) a(i), range({p}) b(j)"
