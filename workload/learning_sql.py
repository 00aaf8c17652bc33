"""SQL that repeats the clustering step by step: draws, candidates, choice of centers, moves, labels, scores and main directions.

Each step is a named table; steps that are repeated are written out. Features are the rows of entries (item_id, pos, value), nx their squared norms.
"""

from __future__ import annotations

from tabulon.operators import kmeans

#: Doublings of the exponent of the covariance matrix until only its main direction is left.
SQUARINGS = 40


def features_sql(numerics: tuple[str, ...]) -> str:
    """positions, entries and norms from the scaled numerics and the vocabulary."""
    first = "".join(f"\n    union all select item_id, {i} as pos, {c} as value from scaled where {c} <> 0" for i, c in enumerate(numerics))
    return f"""
ranked_words as (select token, cast({len(numerics) - 1} + row_number() over (order by row_count desc, token) as bigint) as pos from vocabulary),
entries as materialized (select item_id, pos, 1e0 as value from presence join ranked_words using (token){first}),
positions as materialized (select range as pos from range(0, {len(numerics)} + (select count(*) from vocabulary))),
norms as materialized (select item_id, coalesce(sum(value * value), 0) as nx from items left join entries using (item_id) group by item_id),
dense as materialized (select item_id, list(coalesce(value, 0e0) order by pos) as v from (select item_id, pos from norms, positions) left join entries using (item_id, pos) group by item_id)"""


def _drawn(step: int) -> str:
    return f"cast('0x' || substr(md5('{kmeans.SEED}:{step}:' || item_id), 1, 13) as bigint) / 4503599627370496e0"


def _squared(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def kmeans_sql(name: str, ks: str, max_iter: int, largest: int) -> str:
    """Tables <name>_centers (k, cluster, v) and <name>_labels (k, item_id, cluster). ks: a query for the k wanted, largest of them at most."""
    wanted = f"(select max(k) from {name}_ks)"
    parts = [f"{name}_ks as materialized ({ks})", f"{name}_c0 as materialized (select 0 as no, item_id from norms order by {_drawn(0)}, item_id limit 1)"]
    for step in range(1, kmeans.ROUNDS + 1):
        old = f"{name}_c{step - 1}"
        parts += [
            f"""{name}_d{step} as materialized (select n.item_id, min(greatest(n.nx + m.nx - 2 * list_dot_product(x.v, y.v), 0)) as d
             from norms n join dense x using (item_id), {old} c join norms m on m.item_id = c.item_id join dense y on y.item_id = c.item_id group by n.item_id)""",
            f"""{name}_c{step} as materialized (select * from {old} union all
             select (select count(*) from {old}) - 1 + row_number() over (order by {_drawn(step)}, item_id), item_id from {name}_d{step}
             where (select sum(d) from {name}_d{step}) > 0 and {_drawn(step)} < {kmeans.OVERSAMPLING} * {wanted} * d / (select sum(d) from {name}_d{step}))""",
        ]
    last = f"{name}_c{kmeans.ROUNDS}"
    parts += [
        f"""{name}_near as materialized (select n.item_id, min(struct_pack(d := greatest(n.nx + m.nx - 2 * list_dot_product(x.v, y.v), 0), no := c.no)).no as no
         from norms n join dense x using (item_id), {last} c join norms m on m.item_id = c.item_id join dense y on y.item_id = c.item_id group by n.item_id)""",
        f"{name}_weighed as materialized (select c.no, y.v, count(a.item_id) as weight from {last} c join dense y using (item_id) left join {name}_near a on a.no = c.no group by c.no, y.v)",
        f"{name}_p1 as materialized (select 1 as pick, no, v from {name}_weighed order by weight desc, no limit 1)",
    ]
    for pick in range(2, largest + 1):
        parts.append(
            f"""{name}_p{pick} as materialized (select * from {name}_p{pick - 1} union all select {pick}, no, v from (
             select w.no, w.v, w.weight * min({_squared('w.v', 'p.v')}) as gain from {name}_weighed w, {name}_p{pick - 1} p group by w.no, w.v, w.weight order by gain desc, w.no limit 1)
             where gain > 0)"""
        )
    parts.append(f"{name}_m0 as materialized (select k, pick as c, v, false as done from {name}_ks, {name}_p{largest} where pick <= k)")
    for step in range(1, max_iter + 1):
        old = f"{name}_m{step - 1}"
        parts += [
            f"""{name}_a{step} as materialized (select k, n.item_id, min(struct_pack(d := greatest(n.nx + list_dot_product(m.v, m.v) - 2 * list_dot_product(x.v, m.v), 0), c := m.c)).c as c
             from norms n join dense x using (item_id), {old} m where not m.done group by k, n.item_id)""",
            f"""{name}_s{step} as materialized (select k, c, list(s / n order by pos) as mean from (
             select a.k, a.c, p.pos, coalesce(sum(x.v[p.pos + 1]), 0) as s, count(*) as n from {name}_a{step} a join dense x using (item_id), positions p group by a.k, a.c, p.pos) group by k, c)""",
            f"""{name}_n{step} as (select m.k, m.c, m.done, m.v as before, coalesce(list_transform(s.mean, lambda x: round(x, {kmeans.DIGITS})), m.v) as v from {old} m left join {name}_s{step} s on s.k = m.k and s.c = m.c)""",
            f"""{name}_m{step} as materialized (select k, c, v, done or max({_squared('v', 'before')}) over (partition by k) <= {kmeans.TOLERANCE**2!r} as done from {name}_n{step})""",
        ]
    parts += [
        f"{name}_centers as materialized (select k, cast(row_number() over (partition by k order by v) - 1 as integer) as cluster, v from {name}_m{max_iter})",
        f"""{name}_labels as materialized (select k, n.item_id, min(struct_pack(d := greatest(n.nx + list_dot_product(m.v, m.v) - 2 * list_dot_product(x.v, m.v), 0), c := m.cluster)).c as cluster
         from norms n join dense x using (item_id), {name}_centers m group by k, n.item_id)""",
    ]
    return ",\n".join(parts)


def silhouette_sql(name: str) -> str:
    """Table <name>_scores (k, silhouette), from the labels, the sums of their clusters and the entries."""
    return f"""
{name}_sizes as (select k, cluster, count(*) as n, sum(nx) as psi from {name}_labels join norms using (item_id) group by k, cluster),
{name}_sums as (select k, cluster, list(s order by pos) as y from (
    select k, cluster, p.pos, sum(x.v[p.pos + 1]) as s from {name}_labels join dense x using (item_id), positions p group by k, cluster, p.pos) group by k, cluster),
{name}_away as (select l.k, l.item_id, l.cluster as own, z.cluster as other, z.n, greatest(z.n * m.nx + z.psi - 2 * list_dot_product(x.v, t.y), 0) as total
    from {name}_labels l join norms m using (item_id) join dense x using (item_id) join {name}_sizes z on z.k = l.k join {name}_sums t on t.k = z.k and t.cluster = z.cluster),
{name}_sides as (select k, item_id, max(case when own = other then total / greatest(n - 1, 1) end) as a, min(case when own <> other then total / n end) as b,
    max(case when own = other then n end) as n from {name}_away group by k, item_id),
{name}_scores as materialized (select k, round(avg(case when n > 1 and b is not null and greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end), 4) as silhouette from {name}_sides group by k)"""


def directions_sql() -> str:
    """Tables direction_1 and direction_2 (v): the main components, by squaring the covariance matrix; the largest loading is positive."""
    parts = [
        "mean as materialized (select list(s order by pos) as m, any_value(n) as n from (select pos, sum(v[pos + 1]) / count(*) as s, count(*) as n from dense, positions group by pos))",
        """covariance as materialized (select p.pos as i, q.pos as j, sum((v[p.pos + 1] - m[p.pos + 1]) * (v[q.pos + 1] - m[q.pos + 1])) / (any_value(n) - 1) as x
         from dense, mean, positions p, positions q group by p.pos, q.pos)""",
    ]
    matrix = "covariance"
    for number in (1, 2):
        parts.append(f"square_{number}_0 as materialized (select i, j, x / (select max(abs(x)) from {matrix}) as x from {matrix})")
        for step in range(1, SQUARINGS + 1):
            old = f"square_{number}_{step - 1}"
            parts.append(
                f"""square_{number}_{step} as materialized (select i, j, x / max(abs(x)) over () as x from (
                 select a.i, b.j, sum(a.x * b.x) as x from {old} a join {old} b on a.j = b.i group by a.i, b.j))"""
            )
        power = f"square_{number}_{SQUARINGS}"
        parts += [
            f"column_{number} as (select i, x from {power} where j = (select j from {power} group by j order by sum(x * x) desc, j limit 1))",
            f"unit_{number} as materialized (select i, x / (select sqrt(sum(x * x)) from column_{number}) * (select case when arg_max(x, abs(x)) >= 0 then 1 else -1 end from column_{number}) as x from column_{number})",
            f"direction_{number} as materialized (select list(x order by i) as v from unit_{number})",
        ]
        if number == 1:
            parts += [
                f"value_1 as (select sum(a.x * c.x * b.x) as value from {matrix} c join unit_1 a on a.i = c.i join unit_1 b on b.i = c.j)",
                f"deflated as materialized (select c.i, c.j, c.x - (select value from value_1) * a.x * b.x as x from {matrix} c join unit_1 a on a.i = c.i join unit_1 b on b.i = c.j)",
            ]
            matrix = "deflated"
    return ",\n".join(parts)
