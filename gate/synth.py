"""Synthesizers and their SQL twins: seeded noise, choices and draws written out for three columns of small domains."""

from __future__ import annotations

import math
from itertools import combinations

from gate.core import CUSTOMER, MODE, gauss, gum, lap, num, query, table, uni
from hushframe.synth.aim import ONE_WAY, SELECT, aim
from hushframe.synth.counts import rho_of
from hushframe.synth.factors import sample
from hushframe.synth.mst import BELOW, fit_mst, mst
from hushframe.synth.weights import mwem

COLS = ["c_nationkey", "c_acctbal", "c_mktsegment"]
SIZES = dict(zip(COLS, (25, 10, 5)))
PAIRS = list(combinations(COLS, 2))
DRAWS = 3  # seed of the sampled rows
CODES = ("c_nationkey::int as c_nationkey, least(9, floor((greatest(-1000::double, least(c_acctbal, 10000::double)) - -1000::double) / 11000::double * 10::double)::int) "
         "as c_acctbal, (list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1)::int as c_mktsegment")
DECODED = ("{0} as c_nationkey, -1000::double + ({1} + 0.5::double) * 1100::double as c_acctbal, "
           "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][{2} + 1] as c_mktsegment")
ROWS = "(select count(*) from customer)"
IDS = "ids as materialized (select row_number() over () - 1 as id from customer)"


def name(pair) -> str:
    return ",".join(pair)


def union(parts) -> str:
    return " union all ".join(parts)


def ctes(parts: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} as materialized ({sql})" for n, sql in parts)


def one_way(tag: str, sigma: float) -> list[tuple[str, str]]:
    """c: codes; n1: noisy one-way counts (m, i, n)."""
    cells = union(f"select '{c}' as m, range::int as i, -1 as j from range({k})" for c, k in SIZES.items())
    found = union(f"select '{c}' as m, {c} as i, count(*) as k from c group by 2" for c in COLS)
    return [("c", f"select {CODES} from customer"), ("u1", cells), ("k1", found),
            ("n1", f"select u1.m, u1.i, coalesce(k, 0) + {gauss(f'{tag}|n', ['u1.m', 'u1.i', 'u1.j'], sigma)} as n from u1 left join k1 on k1.m = u1.m and k1.i = u1.i")]


def picked(k: int, scores: str, temperature: float, tag: str, more: str = "") -> str:
    """The pair of the noisily highest score."""
    return f"select m from {scores} {more} order by e / {num(temperature)} - ln(-ln({uni(tag, [str(k)], 'm')})) desc, m desc limit 1"


def drawn(tag: str, ladder: str, on: str, ids: str, keep: str = "", more: str = "") -> str:
    """Per row the first code whose weights added up exceed its uniform; the ladder has g and w."""
    u = uni(tag, ["d.id"], seed=DRAWS) if not tag.startswith("(") else tag
    return (f"select id, {keep} coalesce(min(g) filter (upto > u * tot), max(g)) as g from (select d.*, {more} l.g, l.upto, l.tot, {u} as u from {ids} d join {ladder} l on {on}) "
            f"group by all")


def climbed(source: str, keys: str) -> str:
    """A ladder of the cells of ``source`` per key."""
    by = f"partition by {keys}" if keys else ""
    return f"select *, sum(w) over ({by} order by g rows unbounded preceding) as upto, sum(w) over ({by}) as tot from ({source}) where w > 0"


# -- the spanning tree --------------------------------------------------------------------------------------------


def mst_tables(epsilon: float, delta: float) -> list[tuple[str, str]]:
    """Groups with shares (p), the picked edges, and cond: child, parent, pg, g, w."""
    rho = rho_of(epsilon, delta) / 3.0
    one, two, temperature = math.sqrt(3 / (2.0 * rho)), math.sqrt(2 / (2.0 * rho)), 2.0 / math.sqrt(8.0 * rho / 2)
    nk, ab, ms = COLS
    at = dict(zip(COLS, ("x.g", "y.g", "z.g")))
    has = lambda p: f"exists (select 1 from edges where m = '{name(p)}')"
    return one_way("mst1", one) + [
        ("codes", f"select m, i, case when n < {num(BELOW * one)} then -1 else i end as g, n from n1"),
        ("grp", "select m, g, sum(n) as n, count(*) as k from codes group by 1, 2"),
        ("tot", "select m, sum(greatest(n, 0)) as t, count(*) as k from grp group by 1"),
        ("p", "select grp.m, g, case when t > 0 then greatest(n, 0) / t else 1::double / tot.k end as p from grp join tot on tot.m = grp.m"),
        ("whole", "select sum(greatest(t, 1::double)) / 3::double as total from tot"),
        ("r", f"select x.g as {nk}, y.g as {ab}, z.g as {ms} from c join codes x on x.m = '{nk}' and x.i = c.{nk} join codes y on y.m = '{ab}' and y.i = c.{ab} "
              f"join codes z on z.m = '{ms}' and z.i = c.{ms}"),
        ("k2", union(f"select '{name(s)}' as m, {s[0]} as i, {s[1]} as j, count(*) as k from r group by 2, 3" for s in PAIRS)),
        ("u2", union(f"select '{name(s)}' as m, x.g as i, y.g as j, x.p * y.p * total as mo from p x, p y, whole where x.m = '{s[0]}' and y.m = '{s[1]}'" for s in PAIRS)),
        ("s", "select u2.m, sum(abs(coalesce(k, 0) - mo)) as e from u2 left join k2 on k2.m = u2.m and k2.i = u2.i and k2.j = u2.j group by 1"),
        ("e0", picked(0, "s", temperature, "mst-edge")),
        ("edges", f"select m from e0 union all select * from ({picked(1, 's', temperature, 'mst-edge', 'where m not in (select m from e0)')})"),
        ("n2", f"select u2.m, u2.i, u2.j, greatest(coalesce(k, 0) + {gauss('mst2|n', ['u2.m', 'u2.i', 'u2.j'], two)}, 0) as n from u2 join edges on edges.m = u2.m "
               f"left join k2 on k2.m = u2.m and k2.i = u2.i and k2.j = u2.j"),
        ("dir", union([
            f"select '{ab}' as child, '{nk}' as parent, i as pg, j as g, n from n2 where m = '{nk},{ab}'",
            f"select '{ms}', '{nk}', i, j, n from n2 where m = '{nk},{ms}'",
            f"select '{ab}', '{ms}', j, i, n from n2 where m = '{ab},{ms}' and not {has((nk, ab))}",
            f"select '{ms}', '{ab}', i, j, n from n2 where m = '{ab},{ms}' and not {has((nk, ms))}"])),
        ("cond", "select child, parent, pg, dir.g, case when sum(n) over (partition by child, pg) > 0 then n / sum(n) over (partition by child, pg) else p end as w "
                 "from dir join p on p.m = child and p.g = dir.g"),
    ]


def leaf(column: str, groups: str, allowed: str = "true") -> list[tuple[str, str]]:
    """x_<column> (id, g): the codes of drawn groups (id, g), evenly drawn among the allowed ones of a group."""
    ladder = climbed(f"select m.g as key, m.i as g, 1::double / count(*) over (partition by m.g) as w, ({allowed.format('m.i')}) as ok from codes m where m.m = '{column}'", "key")
    ladder = ladder.replace("where w > 0", "where w > 0 and ok")
    return [(f"l_{column}", ladder), (f"x_{column}", drawn(column, f"l_{column}", "l.key = d.k9", f"(select id, g as k9 from {groups})"))]


def mst_sql(epsilon: float, delta: float) -> str:
    nk, ab, ms = COLS
    tag = "case l.child " + " ".join(f"when '{c}' then {uni(f'{c}~', ['d.id'], seed=DRAWS)}" for c in COLS) + " end"
    parts = mst_tables(epsilon, delta) + [
        ("ids", "select row_number() over () - 1 as id from customer"),
        ("lr", climbed(f"select g, p as w from p where m = '{nk}'", "")), ("lc", climbed("select child, parent, pg, g, w from cond", "child, pg")),
        ("d0", drawn(f"{nk}~", "lr", "true", "ids")),
        ("d1", drawn(f"({tag})", "lc", f"l.parent = '{nk}' and l.pg = d.k", "(select id, g as k from d0)", "child,", "l.child,")),
        ("d2", drawn(f"({tag})", "lc", f"l.parent = d.c and l.pg = d.k and l.child <> '{nk}'", "(select id, child as c, g as k from d1)", "child,", "l.child,")),
        ("d", f"select id, '{nk}' as child, g from d0 union all select id, child, g from d1 union all select id, child, g from d2"),
        *leaf(nk, f"d where child = '{nk}'"), *leaf(ab, f"d where child = '{ab}'"), *leaf(ms, f"d where child = '{ms}'")]
    return f"with {ctes(parts)} select {DECODED.format('a.g', 'b.g', 'e.g')} from x_{nk} a join x_{ab} b on b.id = a.id join x_{ms} e on e.id = a.id"


def conditional_sql(epsilon: float, delta: float) -> str:
    """The condition splits into one on the balance's bin and one on the segment."""
    nk, ab, ms = COLS
    rich, builds = "-1000::double + ({0} + 0.5::double) * 1100::double > 5000", "{0} = 1"
    part = lambda column, allowed: f"select g, avg(({allowed.format('i')})::int) as f from codes where m = '{column}' group by 1"
    second = f"(case when swap then {uni(f'{ms}~', ['d.id'], seed=DRAWS)} else {uni(f'{ab}~', ['d.id'], seed=DRAWS)} end)"
    third = f"(case when swap then {uni(f'{ab}~', ['d.id'], seed=DRAWS)} else {uni(f'{ms}~', ['d.id'], seed=DRAWS)} end)"
    parts = mst_tables(epsilon, delta) + [
        ("f1", part(ab, rich)), ("f2", part(ms, builds)),
        ("sw", f"select not exists (select 1 from edges where m = '{nk},{ab}') as swap"),
        ("j", f"select a.g as g0, b.g as g1, e.g as g2, a.p * b.w * e.w * f1.f * f2.f as w from p a join cond b on a.m = '{nk}' and b.child = '{ab}' join cond e on e.child = '{ms}' "
              f"join f1 on f1.g = b.g join f2 on f2.g = e.g where b.pg = (case b.parent when '{nk}' then a.g else e.g end) and e.pg = (case e.parent when '{nk}' then a.g else b.g end)"),
        ("jj", "select g0, case when swap then g2 else g1 end as y, case when swap then g1 else g2 end as z, w from j, sw"),
        ("ids", f"select row_number() over () - 1 as id, swap from customer, sw qualify id < {ROWS} // 10"),
        ("l0", climbed("select g0 as g, sum(w) as w from jj group by 1", "")), ("l1", climbed("select g0 as k, y as g, sum(w) as w from jj group by 1, 2", "k")),
        ("l2", climbed("select g0 as k, y as k2, z as g, w from jj", "k, k2")),
        ("d0", drawn(f"{nk}~", "l0", "true", "ids", "swap,")), ("d1", drawn(second, "l1", "l.k = d.k0", "(select id, swap, g as k0 from d0)", "swap, k0,")),
        ("d2", drawn(third, "l2", "l.k = d.k0 and l.k2 = d.k1", "(select id, swap, k0, g as k1 from d1)", "swap, k0, k1,")),
        ("d", "select id, k0 as g0, case when swap then g else k1 end as g1, case when swap then k1 else g end as g2 from d2"),
        *leaf(nk, "(select id, g0 as g from d)"), *leaf(ab, "(select id, g1 as g from d)", rich), *leaf(ms, "(select id, g2 as g from d)", builds)]
    return f"with {ctes(parts)} select {DECODED.format('a.g', 'b.g', 'e.g')} from x_{nk} a join x_{ab} b on b.id = a.id join x_{ms} e on e.id = a.id"


# -- draws from a joint table x0, x1, x2, w ---------------------------------------------------------------------------


def from_joint(joint: str, swap: str = "false") -> list[tuple[str, str]]:
    """x (id, x0, x1, x2): the first column, then the second and the third, or the third and the second where ``swap`` holds."""
    nk, ab, ms = (uni(c, ["d.id"], seed=DRAWS) for c in COLS)
    return [
        ("sw", f"select {swap} as swap"), ("ids", "select row_number() over () - 1 as id, swap from customer, sw"),
        ("jj", f"select x0, case when swap then x2 else x1 end as y, case when swap then x1 else x2 end as z, w from {joint}, sw"),
        ("l0", climbed("select x0 as g, sum(w) as w from jj group by 1", "")), ("l1", climbed("select x0 as k, y as g, sum(w) as w from jj group by 1, 2", "k")),
        ("l2", climbed("select x0 as k, y as k2, z as g, w from jj", "k, k2")),
        ("d0", drawn(f"({nk})", "l0", "true", "ids", "swap,")),
        ("d1", drawn(f"(case when swap then {ms} else {ab} end)", "l1", "l.k = d.k0", "(select id, swap, g as k0 from d0)", "swap, k0,")),
        ("d2", drawn(f"(case when swap then {ab} else {ms} end)", "l2", "l.k = d.k0 and l.k2 = d.k1", "(select id, swap, k0, g as k1 from d1)", "swap, k0, k1,")),
        ("x", "select id, k0 as x0, case when swap then g else k1 end as x1, case when swap then k1 else g end as x2 from d2")]


# -- the adaptive synthesizer -------------------------------------------------------------------------------------------


def aim_sql(epsilon: float, delta: float, rounds: int = 4) -> str:
    rho = rho_of(epsilon, delta)
    select, spend = SELECT * (1.0 - ONE_WAY) * rho / rounds, (1.0 - SELECT) * (1.0 - ONE_WAY) * rho / rounds
    sigma, temperature = 1 / math.sqrt(2.0 * spend), 2.0 / math.sqrt(8.0 * select)
    expected = math.sqrt(2.0 / math.pi) * sigma
    axis = dict(zip(COLS, ("x0", "x1", "x2")))
    cells = "case m " + " ".join(f"when '{name(s)}' then {num(expected * SIZES[s[0]] * SIZES[s[1]])}" for s in PAIRS) + " end"
    answers = lambda j: union(f"select '{name(s)}' as m, {axis[s[0]]} as i, {axis[s[1]]} as j, sum(w) as w from {j} group by 2, 3" for s in PAIRS)
    which = lambda pick, k: "case " + pick + " " + " ".join(f"when '{name(s)}' then {axis[s[k]]}" for s in PAIRS) + " end"
    parts = one_way("aim1", math.sqrt(3 / (2.0 * ONE_WAY * rho))) + [
        ("tot", "select m, sum(greatest(n, 0)) as t, count(*) as k from n1 group by 1"),
        ("p", "select n1.m, i, case when t > 0 then greatest(n, 0) / t else 1::double / k end as p from n1 join tot on tot.m = n1.m"),
        ("whole", "select avg(greatest(t, 1::double)) as total from tot"),
        ("k2", union(f"select '{name(s)}' as m, {s[0]} as i, {s[1]} as j, count(*) as k from c group by 2, 3" for s in PAIRS)),
        ("u2", union(f"select '{name(s)}' as m, x.range::int as i, y.range::int as j from range({SIZES[s[0]]}) x, range({SIZES[s[1]]}) y" for s in PAIRS)),
        ("j0", f"select x.i as x0, y.i as x1, z.i as x2, x.p * y.p * z.p as w from p x, p y, p z where x.m = '{COLS[0]}' and y.m = '{COLS[1]}' and z.m = '{COLS[2]}'")]

    def stepped(j: str, q: str, target: str, pick: str, into: str) -> tuple[str, str]:
        """One step of proportional fitting of the joint table."""
        return into, (f"select x0, x1, x2, v.w * t.t / q.w as w from (select *, {pick} as pm, {which(pick, 0)} as pi, {which(pick, 1)} as pj from {j}) v "
                      f"join {target} t on t.i = pi and t.j = pj join {q} q on q.m = pm and q.i = pi and q.j = pj where t.t > 0 and q.w > 0")

    def target(pick: str, upto: int) -> str:
        every = union(f"select f{r}.* from f{r} join k{r}_ on k{r}_.m = f{r}.m" for r in range(upto + 1))
        mean = f"select i, j, greatest(avg(n), 0) as n from ({every}) where m = {pick} group by 1, 2"
        return f"select i, j, case when sum(n) over () > 0 then n / sum(n) over () else 1::double / count(*) over () end as t from ({mean})"

    for r in range(rounds):
        pick = f"(select m from k{r}_)"
        parts += [
            (f"q{r}", answers(f"j{r}")),
            (f"s{r}", f"select k2.m, sum(abs(k - total * coalesce(w, 0)) - total * coalesce(w, 0)) + max(total) - max({cells.replace('case m', 'case k2.m')}) as e "
                      f"from k2 join whole on true left join q{r} q on q.m = k2.m and q.i = k2.i and q.j = k2.j group by 1"),
            (f"k{r}_", picked(r, f"s{r}", temperature, "aim-pick")),
            (f"f{r}", f"select u2.m, u2.i, u2.j, coalesce(k, 0) + {gauss(f'aim2-{r}|n', ['u2.m', 'u2.i', 'u2.j'], sigma)} as n from u2 left join k2 on k2.m = u2.m and k2.i = u2.i and k2.j = u2.j"),
            (f"t{r}", target(pick, r)), stepped(f"j{r}", f"q{r}", f"t{r}", pick, f"j{r + 1}")]
    last = f"j{rounds}"
    parts += [("seen", union(f"select m from k{r}_" for r in range(rounds)))]
    for k, s in enumerate(PAIRS):  # each measured pair once more, if there are several
        held = f"'{name(s)}'"
        parts += [(f"z{k}", f"select {held} in (select m from seen) and (select count(distinct m) from seen) > 1 as yes"), (f"v{k}", answers(last)), (f"w{k}", target(held, rounds - 1)),
                  stepped(last, f"v{k}", f"w{k}", held, f"y{k}_"),
                  (f"y{k}", f"select x0, x1, x2, w from y{k}_, z{k} where yes union all select x0, x1, x2, w from {last}, z{k} where not yes")]
        last = f"y{k}"
    swap = f"'{name(PAIRS[1])}' in (select m from seen) and '{name(PAIRS[0])}' not in (select m from seen)"
    return f"with {ctes(parts + from_joint(last, swap))} select {DECODED.format('x0', 'x1', 'x2')} from x"


# -- multiplicative weights -----------------------------------------------------------------------------------------------


def weights_of(columns: list[str], epsilon: float, iterations: int, mark: str) -> list[tuple[str, str]]:
    """w<mark> (k0, …, w): the weights of a component's cells."""
    sets = [(c,) for c in columns] + list(combinations(columns, 2))
    share, k = epsilon / (2.0 * iterations), [f"k{i}" for i in range(len(columns))]
    spelled = lambda s, null="null::int": ", ".join(f"{c if c in s else null} as k{i}" for i, c in enumerate(columns))
    ranges = lambda s: ", ".join(f"range({SIZES[c]}) as t{i}({c})" for i, c in enumerate(s))
    same = lambda a, b: " and ".join(f"{a}.{x} is not distinct from {b}.{x}" for x in k)
    ints = lambda s: ", ".join(f"{c if c in s else 'null'}::int as k{i}" for i, c in enumerate(columns))
    cells = union(f"select '{name(s)}' as m, {ints(s)} from {ranges(s)}" for s in sets)
    found = union(f"select '{name(s)}' as m, {spelled(s)}, count(*) as c from c group by all" for s in sets)
    parts = [(f"u{mark}", cells), (f"f{mark}", found),
             (f"e{mark}", f"select a.*, coalesce(b.c, 0)::double as n from u{mark} a left join f{mark} b on b.m = a.m and {same('a', 'b')}"),
             (f"w{mark}0", f"select {', '.join(f'{c}::int as k{i}' for i, c in enumerate(columns))}, 1::double as w from {ranges(columns)}")]
    for t in range(iterations):
        w = f"w{mark}{t}"
        answers = union(f"select '{name(s)}' as m, {', '.join(f'k{i}' if c in s else f'null::int as k{i}' for i, c in enumerate(columns))}, sum(w) as w from {w} group by all" for s in sets)
        keys = ["q.m", *[f"q.{x}" for x in k]]
        parts += [
            (f"a{mark}{t}", f"select e.*, a.w * {ROWS}::double / sum(a.w) over (partition by e.m) as model from e{mark} e join ({answers}) a on a.m = e.m and {same('a', 'e')}"),
            (f"g{mark}{t}", f"select * from a{mark}{t} q order by abs(n - model) + {gum(f'mwem-pick{t}|gap', keys, 2.0 / share)} desc limit 1"),
            (f"x{mark}{t}", f"select {', '.join(k)}, exp((n + {lap(f'mwem-measure{t}|n', keys, 1.0 / share)} - model) / (2::double * {ROWS})) as f from g{mark}{t} q"),
            (f"w{mark}{t + 1}", f"select {', '.join(f'v.{x}' for x in k)}, case when {' and '.join(f'(x.{x} is null or x.{x} = v.{x})' for x in k)} then w * f else w end as w "
                                f"from {w} v, x{mark}{t} x")]
    return parts + [(f"w{mark}", f"select * from w{mark}{iterations}")]


def mwem_sql(epsilon: float, iterations: int, split: int) -> str:
    groups = [COLS[i:i + split] for i in range(0, 3, split)]
    parts = [("c", f"select {CODES} from customer")]
    for g, columns in enumerate(groups):
        parts += weights_of(columns, epsilon / len(groups), iterations, "abc"[g])
    places = [(g, i) for g, columns in enumerate(groups) for i in range(len(columns))]
    joint = f"select {', '.join(f'w{g}.k{i} as x{n}' for n, (g, i) in enumerate(places))}, {' * '.join(f'w{g}.w' for g in range(len(groups)))} as w from " + ", ".join(
        f"w{'abc'[g]} w{g}" for g in range(len(groups)))
    return f"with {ctes(parts + [('j', joint)] + from_joint('j'))} select {DECODED.format('x0', 'x1', 'x2')} from x"


@query("mwem_sample", mwem_sql(4.0, 5, 3))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    n = customers.count()
    return sample(mwem(customers, CUSTOMER, COLS, 4.0, MODE, iterations=5, rows=n), spark, n, seed=DRAWS)


@query("mwem_split_sample", mwem_sql(4.0, 4, 2))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    n = customers.count()
    return sample(mwem(customers, CUSTOMER, COLS, 4.0, MODE, iterations=4, rows=n, split_factor=2), spark, n, seed=DRAWS)


@query("mst_sample", mst_sql(2.0, 1e-5))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return mst(customers, CUSTOMER, COLS, 2.0, 1e-5, MODE, n=customers.count(), seed=DRAWS)


@query("aim_sample", aim_sql(2.0, 1e-5))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return sample(aim(customers, CUSTOMER, COLS, 2.0, 1e-5, MODE, max_model_size=50.0), spark, customers.count(), seed=DRAWS)


@query("conditional_sample", conditional_sql(2.0, 1e-5))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    model = fit_mst(customers, CUSTOMER, COLS, 2.0, 1e-5, MODE)
    return sample(model, spark, customers.count() // 10, "c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", seed=DRAWS)
