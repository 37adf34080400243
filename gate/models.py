"""Private models and synthesizers on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gate.core import CUSTOMER, FLAGS, LINEITEM, MODE, SEGMENTS, clamp, exact, gum, lap, num, out, query, rounded, table, uni, unit
from hushframe.ml.base import accuracy, r_squared
from hushframe.ml.chain import DPPipeline
from hushframe.ml.groups import DPDecisionTree, DPGaussianNB, DPKMeans, DPRandomForest
from hushframe.ml.linear import DPPCA, DPLinearRegression, DPLogisticRegression, DPStandardScaler
from hushframe.synth.fidelity import fidelity
from hushframe.synth.prepare import synth_encode

QB, PB, DB = (0.0, 50.0), (0.0, 100000.0), (0.0, 0.1)
QU, PU, DU = unit("l_quantity", *QB), unit("l_extendedprice", *PB), unit("l_discount", *DB)


def _li(spark, sf):
    return table(spark, sf, "lineitem")


# -- sufficient statistics -------------------------------------------------------------------------------------


def _scaler_sql() -> str:
    parts, share = [], 2.0 / 5
    for i, u in enumerate((QU, PU)):
        parts += [f"{exact(u, 1.0)} + {lap(f'scaler|s{i}', [], 1.0 / share)} as s{i}", f"{exact(f'{u} * {u}', 1.0)} + {lap(f'scaler|q{i}', [], 1.0 / share)} as q{i}"]
    return f"n as (select count(*)::double + {lap('scaler|n', [], 1.0 / share)} as n, {', '.join(parts)} from lineitem)"


def _mean_std(i: int, low: float, high: float) -> tuple[str, str]:
    middle, half = (low + high) / 2, (high - low) / 2
    return f"{num(middle)} + {num(half)} * (s{i} / n)", f"{num(half)} * sqrt(q{i} / n - (s{i} / n) * (s{i} / n))"


_M0, _S0 = _mean_std(0, *QB)
_M1, _S1 = _mean_std(1, *PB)


@query("standard_scaler", (
    f"with {_scaler_sql()} select * from (select 'mean' as name, 0 as i, 0 as j, {out(_M0, 'value', 4)} from n union all select 'mean', 1, 0, {out(_M1, 'value', 4)} from n "
    f"union all select 'std', 0, 0, {out(_S0, 'value', 4)} from n union all select 'std', 1, 0, {out(_S1, 'value', 4)} from n)"))
def _(spark, sf):
    model = DPStandardScaler(2.0, {"l_quantity": QB, "l_extendedprice": PB}).fit(_li(spark, sf), MODE)
    return rounded(model.to_frame(spark), 4)


@query("scaled_rows", (
    f"with {_scaler_sql()} select l_orderkey, l_linenumber, round((l_quantity - ({_M0})) / ({_S0}), 6) + 0.0::double as l_quantity from lineitem, n"))
def _(spark, sf):
    li = _li(spark, sf)
    model = DPStandardScaler(2.0, {"l_quantity": QB, "l_extendedprice": PB}).fit(li, MODE)
    return rounded(model.transform(li).select("l_orderkey", "l_linenumber", "l_quantity"))


def _linear_sql() -> str:
    terms, share = ["1::double", QU, PU], 3.0 / 5
    sums = [f"{exact(f'{terms[i]} * {terms[j]}', 1.0)} + {lap(f'linear|m_{i}_{j}', [], 1.0 / share)} as m_{i}_{j}" for i in range(2) for j in range(i, 3)]
    return (
        f"n as (select {', '.join(sums)} from lineitem), "
        f"w as (select (m_0_0 * m_1_2 - m_0_1 * m_0_2) / (m_0_0 * m_1_1 - m_0_1 * m_0_1) as slope, "
        f"(m_0_2 * m_1_1 - m_0_1 * m_1_2) / (m_0_0 * m_1_1 - m_0_1 * m_0_1) as base from n), "
        f"c as (select 50000::double * slope / 25::double as coefficient, 50000::double + 50000::double * (base - slope * 25::double / 25::double) as intercept from w)")


def _linear(spark, sf):
    return DPLinearRegression(3.0, {"l_quantity": QB}, PB).fit(_li(spark, sf), "l_extendedprice", MODE)


@query("linear_regression", (
    f"with {_linear_sql()} select 'intercept' as name, 0 as i, 0 as j, {out('intercept', 'value', 3)} from c union all select 'coefficient', 0, 0, {out('coefficient', 'value', 3)} from c"))
def _(spark, sf):
    return rounded(_linear(spark, sf).to_frame(spark), 3)


@query("linear_prediction", (
    f"with {_linear_sql()} select l_orderkey, l_linenumber, round(intercept + coefficient * l_quantity, 3) as prediction from lineitem, c"))
def _(spark, sf):
    return rounded(_linear(spark, sf).predict(_li(spark, sf)).select("l_orderkey", "l_linenumber", "prediction"), 3)


_PRED = "(intercept + coefficient * l_quantity)"


@query("regression_score", (
    f"with {_linear_sql()}, u as (select {PU} as y, {unit('p', *PB)} as p from (select l_extendedprice, {_PRED} as p from lineitem, c)), "
    f"s as (select count(*)::double + {lap('score|rows', [], 4.0)} as n, {exact('y', 1.0)} + {lap('score|sy', [], 4.0)} as sy, "
    f"{exact('y * y', 1.0)} + {lap('score|syy', [], 4.0)} as syy, {exact('(y - p) * (y - p)', 4.0)} + {lap('score|srr', [], 16.0)} as srr from u) "
    f"select {out('1::double - srr / (syy - sy * sy / n)', 'r2')} from s"))
def _(spark, sf):
    return rounded(r_squared(_linear(spark, sf).predict(_li(spark, sf)), "prediction", "l_extendedprice", PB, 1.0, MODE))


def _nb_sql() -> str:
    share, prims = 2.0 / 5, ["count(*)::double as n"]
    for i, u in enumerate((QU, PU)):
        prims += [f"{exact(u, 1.0)} as s{i}", f"{exact(f'{u} * {u}', 1.0)} as q{i}"]
    names = ["n", "s0", "q0", "s1", "q1"]
    noisy = ", ".join(f"{c} + {lap(f'bayes|{c}', ['l_returnflag'], 1.0 / share)} as {c}" for c in names)
    return f"e as (select l_returnflag, {', '.join(prims)} from lineitem group by 1), b as (select l_returnflag, {noisy} from e)"


def _nb(spark, sf):
    return DPGaussianNB(2.0, {"l_quantity": QB, "l_extendedprice": PB}, FLAGS).fit(_li(spark, sf), "l_returnflag", MODE)


@query("naive_bayes", (
    f"with {_nb_sql()}, k as (select *, (row_number() over (order by l_returnflag) - 1)::int as k from b) "
    f"select 'prior' as name, k as i, 0 as j, {out('n / (select sum(n) from b)', 'value')} from k "
    + "".join(f"union all select 'mean', k, {i}, {out(f's{i} / n', 'value')} from k union all select 'variance', k, {i}, "
              f"{out(f'q{i} / n - (s{i} / n) * (s{i} / n)', 'value')} from k " for i in range(2))))
def _(spark, sf):
    return rounded(_nb(spark, sf).to_frame(spark))


def _score(i: int, u: str) -> str:
    mean, variance = f"(s{i} / n)", f"(q{i} / n - (s{i} / n) * (s{i} / n))"
    return f"- 0.5::double * ln(2::double * pi() * {variance}) - ({u} - {mean}) * ({u} - {mean}) / (2::double * {variance})"


# order and line number do not identify a row of lineitem, so the SQL numbers the rows itself
_NUMBERED = "l as (select row_number() over () as id, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount from lineitem)"


@query("bayes_prediction", (
    f"with {_nb_sql()}, {_NUMBERED}, p as (select id, l_orderkey, l_linenumber, b.l_returnflag as c, ln(n / (select sum(n) from b)) {_score(0, QU)} {_score(1, PU)} as score "
    f"from l, b) select any_value(l_orderkey) as l_orderkey, any_value(l_linenumber) as l_linenumber, arg_max(c, score) as prediction from p group by id"))
def _(spark, sf):
    return _nb(spark, sf).predict(_li(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")


@query("classification_score", (
    f"with s as (select count(*)::double + {lap('acc|rows', [], 4.0)} as n, {exact('(c_mktsegment = segment)::int', 1.0)} + {lap('acc|right', [], 4.0)} as k from "
    f"(select c_mktsegment, case when c_nationkey < 12 then 'BUILDING' else 'MACHINERY' end as segment from customer)) select {out('k / n', 'accuracy')} from s"))
def _(spark, sf):
    guessed = table(spark, sf, "customer").withColumn("segment", F.when(F.col("c_nationkey") < 12, "BUILDING").otherwise("MACHINERY"))
    return rounded(accuracy(guessed, "segment", "c_mktsegment", 0.5, MODE, "acc"))


# -- trees: the shape depends on seed and bounds only, so the SQL holds it as numbers ----------------------------

TREE_BOUNDS = {"l_quantity": QB, "l_extendedprice": PB, "l_discount": DB}
_TREE = DPDecisionTree(1.0, TREE_BOUNDS, FLAGS, depth=3, seed=5)
_FOREST = DPRandomForest(1.0, TREE_BOUNDS, FLAGS, n_estimators=4, depth=2, seed=9)


def _leaf_sql(shape) -> str:
    def walk(node: int) -> str:
        if node >= len(shape.features):
            return str(node - len(shape.features))
        return f"case when {shape.features[node]} < {num(shape.thresholds[node])} then {walk(2 * node + 1)} else {walk(2 * node + 2)} end"
    return walk(0)


def _leaves_sql(est, tree: str) -> str:
    n_leaves, shapes = 2**est.depth, est.shapes()
    leaf = " ".join(f"when {t} then {_leaf_sql(s)}" for t, s in enumerate(shapes))
    return (
        f"r as (select *, {tree} as tree from lineitem), a as (select *, case tree {leaf} end as leaf from r), "
        f"g as (select tree, leaf, list_position({FLAGS!r}, l_returnflag) - 1 as label, count(*) as n from a group by 1, 2, 3), "
        f"d as (select t.range::int as tree, l.range::int as leaf, c.range::int as label from range({len(shapes)}) t, range({n_leaves}) l, range({len(FLAGS)}) c), "
        f"s as (select d.tree, d.leaf, d.label, coalesce(n, 0) + {gum(f'{est.tag}|n', ['d.tree', 'd.leaf', 'd.label'], 1.0 / est.epsilon)} as score "
        f"from d left join g on g.tree = d.tree and g.leaf = d.leaf and g.label = d.label), "
        f"w as (select tree, leaf, arg_max(label, (score, label)) as label from s group by 1, 2)")


_ROUTE = f"floor({uni('tree', ['l_orderkey', 'l_linenumber'], seed=9)} * 4)::int"


@query("decision_tree", f"with {_leaves_sql(_TREE, '0')} select tree, leaf, label from w")
def _(spark, sf):
    return _TREE.leaf_classes(_li(spark, sf), "l_returnflag", [], MODE)


@query("random_forest", f"with {_leaves_sql(_FOREST, _ROUTE)} select tree, leaf, label from w")
def _(spark, sf):
    return _FOREST.leaf_classes(_li(spark, sf), "l_returnflag", ["l_orderkey", "l_linenumber"], MODE)


@query("tree_prediction", (
    f"with {_leaves_sql(_TREE, '0')} select l_orderkey, l_linenumber, {FLAGS!r}[label + 1] as prediction from a join w using (tree, leaf)"))
def _(spark, sf):
    model = _TREE.fit(_li(spark, sf), "l_returnflag", MODE)
    return model.predict(_li(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")


@query("forest_prediction", (
    f"with {_leaves_sql(_FOREST, _ROUTE)}, {_NUMBERED}, v as (select *, 0 as tree, {_leaf_sql(_FOREST.shapes()[0])} as leaf from l "
    + "".join(f"union all select *, {t}, {_leaf_sql(s)} from l " for t, s in enumerate(_FOREST.shapes()) if t)
    + f"), c as (select id, l_orderkey, l_linenumber, label, count(*) as n from v join w using (tree, leaf) group by 1, 2, 3, 4) "
    f"select any_value(l_orderkey) as l_orderkey, any_value(l_linenumber) as l_linenumber, {FLAGS!r}[arg_max(label, (n, -label)) + 1] as prediction from c group by id"))
def _(spark, sf):
    model = _FOREST.fit(_li(spark, sf), "l_returnflag", MODE, ["l_orderkey", "l_linenumber"])
    return model.predict(_li(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")


# -- k-means ----------------------------------------------------------------------------------------------------

_KM = DPKMeans(2.0, k=3, bounds={"l_quantity": QB, "l_extendedprice": PB}, iterations=3, seed=11)


def _kmeans_sql() -> str:
    share = _KM.epsilon / _KM.iterations / 3
    ctes = [f"u as (select {QU} as u0, {PU} as u1 from lineitem)",
            "c0 as (select * from (values " + ", ".join(f"({k}, {num(c[0])}, {num(c[1])})" for k, c in enumerate(_KM.start())) + ") as t(k, x, y))"]
    for i in range(_KM.iterations):
        d = [f"(u0 - (select x from c{i} where k = {k})) * (u0 - (select x from c{i} where k = {k})) + "
             f"(u1 - (select y from c{i} where k = {k})) * (u1 - (select y from c{i} where k = {k}))" for k in range(3)]
        ctes += [
            f"n{i} as (select *, {', '.join(f'{e} as d{k}' for k, e in enumerate(d))} from u)",
            f"a{i} as (select case when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end as cluster, u0, u1 from n{i})",
            f"g{i} as (select cluster, count(*) as n, {exact('u0', 1.0)} as s0, {exact('u1', 1.0)} as s1 from a{i} group by 1)",
            f"z{i} as (select k, x, y, coalesce(n, 0) + {lap(f'kmeans{i}|n', ['k'], 1 / share)} as n, coalesce(s0, 0) + {lap(f'kmeans{i}|s0', ['k'], 1 / share)} as s0, "
            f"coalesce(s1, 0) + {lap(f'kmeans{i}|s1', ['k'], 1 / share)} as s1 from c{i} left join g{i} on k = cluster)",
            f"c{i + 1} as (select k, case when n >= 1 then least(1::double, greatest(-1::double, s0 / n)) else x end as x, "
            f"case when n >= 1 then least(1::double, greatest(-1::double, s1 / n)) else y end as y from z{i})"]
    return ", ".join(ctes)


@query("k_means", (
    f"with {_kmeans_sql()} select 'center' as name, k as i, 0 as j, round(25::double + 25::double * x, 3) as value from c3 "
    f"union all select 'center', k, 1, round(50000::double + 50000::double * y, 3) from c3"))
def _(spark, sf):
    return rounded(_KM.fit(_li(spark, sf), MODE).to_frame(spark), 3)


# -- logistic regression -------------------------------------------------------------------------------------------


def _logistic_sql(epsilon: float, norm: float, iterations: int) -> str:
    """Newton steps of five classes on two features and a constant, 3 x 3 systems by Cramer's rule."""
    share = epsilon / len(SEGMENTS)
    alpha = 0.25 / math.expm1(share / 4.0)  # the budget is below what the curvature alone would take
    usable, root, size = share / 2.0, math.sqrt(0.5), f"greatest(sqrt(a * a + b * b), {num(norm)})"
    u = lambda kind, i: uni("logistic", ["k", f"'{kind}'"], f"'{i}'")
    normal = [f"sqrt(-2::double * ln({u('u', i)})) * cos(2::double * pi() * {u('v', i)})" for i in range(3)]
    x = ["x0", "x1", num(root)]
    grid = lambda e: f"sum(floor(({e}) * 1e9::double + 0.5::double)::hugeint)::double / 1e9::double"
    places = [(i, j) for i in range(3) for j in range(i, 3)]
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"

    def det(columns) -> str:
        c = [[(f"g{i}" if columns[j] == "g" else h(i, j)) for j in range(3)] for i in range(3)]
        return (f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) "
                f"+ {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))")

    ctes = [
        f"f as (select coalesce(c_acctbal, 0)::double as a, coalesce(c_nationkey, 0)::double as b, list_position({SEGMENTS!r}, c_mktsegment) - 1 as y from customer)",
        f"r as materialized (select a / {size} * {num(root)} as x0, b / {size} * {num(root)} as x1, y from f where y >= 0)",
        f"d as (select range as k, {', '.join(f'{e} as d{i}' for i, e in enumerate(normal))}, {num(-2.0 / usable)} * ({' + '.join(f'ln({u(chr(103), i)})' for i in range(3))}) as len "
        f"from (select range, range as k from range({len(SEGMENTS)})))",
        f"b as materialized (select k, {', '.join(f'd{i} / sqrt(d0 * d0 + d1 * d1 + d2 * d2) * len as b{i}' for i in range(3))} from d)",
        f"w0 as (select k, 0::double as w0, 0::double as w1, 0::double as w2, false as done from b)"]
    for t in range(iterations):
        p = f"1::double / (1::double + exp(-greatest(-500::double, least(500::double, x0 * w0 + x1 * w1 + {num(root)} * w2))))"
        sums = [f"{grid(f'(p - t) * {x[i]}')} as s{i}" for i in range(3)] + [f"{grid(f'p * (1::double - p) * {x[i]} * {x[j]}')} as c{i}{j}" for i, j in places]
        ctes += [
            f"s{t} as materialized (select k, {', '.join(sums)} from (select k, x0, x1, (y = k)::int::double as t, {p} as p from r, w{t}) group by k)",
            f"h{t} as (select w.*, {', '.join(f's{i} + {num(alpha)} * w{i} + b{i} as g{i}' for i in range(3))}, "
            f"{', '.join(f'c{i}{j}' + (f' + {num(alpha)}' if i == j else '') + f' as h{i}{j}' for i, j in places)} from w{t} w join s{t} s on s.k = w.k join b on b.k = w.k)",
            f"t{t} as materialized (select k, w0, w1, w2, done, {', '.join(f'{det([chr(103) if j == i else j for j in range(3)])} / {det([0, 1, 2])} as e{i}' for i in range(3))} from h{t})",
            f"n{t} as materialized (select k, {', '.join(f'case when done then w{i} else w{i} - e{i} end as w{i}' for i in range(3))}, done, "
            f"greatest(abs(e0), abs(e1), abs(e2)) as step from t{t})",
            f"w{t + 1} as materialized (select k, w0, w1, w2, done or max(step) over () < 1e-4::double * greatest(1::double, max(greatest(abs(w0), abs(w1), abs(w2))) over ()) as done from n{t})"]
    last = f"w{iterations}"
    return f"with {', '.join(ctes)} " + " union all ".join(
        f"select 'weight' as name, k::int as i, {j} as j, {out(f'{num(root)} * w{j}', 'value', 5)} from {last}" for j in range(3))


@query("logistic_regression", _logistic_sql(2.0, 11000.0, 8))
def _(spark, sf):
    c = table(spark, sf, "customer")
    model = DPLogisticRegression(2.0, data_norm=11000.0, classes=SEGMENTS, max_iter=8).fit(c, ["c_acctbal", "c_nationkey"], "c_mktsegment", MODE)
    return rounded(model.to_frame(spark), 5)


def _pca_sql() -> str:
    """Two columns, so that the eigenvectors of the noisy covariance have a closed form."""
    norm, e = (25.0**2 + 50000.0**2) ** 0.5, 1.0
    x = [f"(coalesce({clamp('l_quantity', *QB)}, 25::double) - 25::double)", f"(coalesce({clamp('l_extendedprice', *PB)}, 50000::double) - 50000::double)"]
    size = f"(greatest(sqrt(x0 * x0 + x1 * x1) / {num(norm)}, 1::double) * {num(norm)})"
    s, p = 2 / (e * 2**0.5), 3 / (e * 2)
    return (
        f"x as (select {x[0]} as x0, {x[1]} as x1 from lineitem), u as (select x0 / {size} as u0, x1 / {size} as u1 from x), "
        f"m as (select count(*)::double + {lap('pca0|n', [], 1 / e)} as n, {exact('u0', 1.0)} + {lap('pca1|s0', [], s)} as s0, {exact('u1', 1.0)} + {lap('pca1|s1', [], s)} as s1, "
        f"{exact('u0 * u0', 1.0)} + {lap('pca2|p_0_0', [], p)} as p00, {exact('u0 * u1', 1.0)} + {lap('pca2|p_0_1', [], p)} as p01, "
        f"{exact('u1 * u1', 1.0)} + {lap('pca2|p_1_1', [], p)} as p11 from u), "
        f"c as (select *, (p00 - s0 * s0 / n) / (n - 1) * {num(norm * norm)} as a, (p01 - s0 * s1 / n) / (n - 1) * {num(norm * norm)} as b, "
        f"(p11 - s1 * s1 / n) / (n - 1) * {num(norm * norm)} as d from m), "
        f"v as (select *, greatest(0, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b)) as top, greatest(0, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b)) as low from c), "
        f"k as (select *, b / sqrt(b * b + (top - a) * (top - a)) as v0, (top - a) / sqrt(b * b + (top - a) * (top - a)) as v1, {num(norm)} as norm from v)")


@query("pca", (
    f"with {_pca_sql()} select 'component' as name, 0 as i, 0 as j, {out('v0 * (case when abs(v0) >= abs(v1) then sign(v0) else sign(v1) end)', 'value', 5)} from k "
    f"union all select 'component', 0, 1, {out('v1 * (case when abs(v0) >= abs(v1) then sign(v0) else sign(v1) end)', 'value', 5)} from k "
    f"union all select 'explained_variance', 0, 0, {out('top / 1000000', 'value', 5)} from k union all select 'explained_variance_ratio', 0, 0, {out('top / (top + low)', 'value', 5)} from k "
    f"union all select 'singular_values', 0, 0, {out('sqrt(top * (n - 1)) / 1000000', 'value', 5)} from k union all select 'mean', 0, 0, {out('(25::double + norm * s0 / n) / 1000000', 'value', 5)} from k "
    f"union all select 'mean', 1, 0, {out('(50000::double + norm * s1 / n) / 1000000', 'value', 5)} from k union all select 'noise_variance', 0, 0, {out('low / 1000000', 'value', 5)} from k"))
def _(spark, sf):
    model = DPPCA(3.0, 1, {"l_quantity": QB, "l_extendedprice": PB}).fit(_li(spark, sf), MODE)
    small = F.col("name").isin("explained_variance_ratio", "component")
    return rounded(model.to_frame(spark).withColumn("value", F.when(small, F.col("value")).otherwise(F.col("value") / 1e6)), 5)


def _chain_sql() -> str:
    """Scaler on the train part, naive Bayes on its scaled rows, noisy accuracy on the test part."""
    scaler = _scaler_sql().replace("from lineitem)", "from t where train)")
    scaler = scaler.replace(num(1.0 / (2.0 / 5)), num(1.0 / (1.0 / 5)))
    u = [unit("x0", -3.0, 3.0), unit("x1", -3.0, 3.0)]
    prims = "count(*)::double as n, " + ", ".join(f"{exact(x, 1.0)} as s{i}, {exact(f'{x} * {x}', 1.0)} as q{i}" for i, x in enumerate(u))
    noisy = ", ".join(f"{c} + {lap(f'bayes|{c}', ['l_returnflag'], 1.0 / (1.0 / 5))} as {c}" for c in ["n", "s0", "q0", "s1", "q1"])
    return (
        f"t as (select row_number() over () as id, l_returnflag, l_quantity, l_extendedprice, {uni('split', ['l_orderkey', 'l_linenumber'], seed=1)} >= 0.2::double as train from lineitem), "
        f"{scaler}, x as (select id, train, l_returnflag, (l_quantity - ({_M0})) / ({_S0}) as x0, (l_extendedprice - ({_M1})) / ({_S1}) as x1 from t, n), "
        f"e as (select l_returnflag, {prims} from x where train group by 1), b as (select l_returnflag, {noisy} from e), "
        f"p as (select id, x.l_returnflag as truth, b.l_returnflag as c, ln(n / (select sum(n) from b)) {_score(0, u[0])} {_score(1, u[1])} as score from x, b where not train), "
        f"g as (select id, any_value(truth) as truth, arg_max(c, score) as guess from p group by id), "
        f"a as (select count(*)::double + {lap('score|rows', [], 4.0)} as n, {exact('(truth = guess)::int', 1.0)} + {lap('score|right', [], 4.0)} as k from g)")


@query("fitted_chain", f"with {_chain_sql()} select {out('greatest(0, least(1, k / n))', 'accuracy')} from a")
def _(spark, sf):
    steps = [DPStandardScaler(1.0, {"l_quantity": QB, "l_extendedprice": PB}), DPGaussianNB(1.0, {"l_quantity": (-3.0, 3.0), "l_extendedprice": (-3.0, 3.0)}, FLAGS)]
    fitted = DPPipeline(steps).fit(_li(spark, sf), ["l_quantity", "l_extendedprice"], "l_returnflag", ["l_orderkey", "l_linenumber"], MODE)
    return rounded(fitted.score(0.5, MODE))


# -- chains with components, priced imputation and scores without a target ------------------------------------------

_TRAIN = f"t as (select row_number() over () as id, l_returnflag, l_quantity, l_extendedprice, {uni('split', ['l_orderkey', 'l_linenumber'], seed=1)} >= 0.2::double as train from lineitem)"
_KEY = ["l_orderkey", "l_linenumber"]
_TWO = {"l_quantity": QB, "l_extendedprice": PB}
_MOST = 50.0**2 + 100000.0**2
_IN = [f"coalesce({clamp('l_quantity', *QB)}, 25::double)", f"coalesce({clamp('l_extendedprice', *PB)}, 50000::double)"]


def _trained(sql: str) -> str:
    return sql.replace("from lineitem)", "from t where train)")


def _distance_sql(distance: str, source: str) -> str:
    share = f"greatest(0::double, least(1::double, ({distance}) / {num(_MOST)}))"
    return (f"a as (select {exact(share, 1.0)} + {lap('score|d', [], 4.0)} as d, count(*)::double + {lap('score|rows', [], 4.0)} as n from {source}) "
            f"select {out(f'greatest(0::double, d / n) * {num(_MOST)} / 1000000', 'mean_squared_distance', 4)} from a")


def _scored(spark, sf, step):
    fitted = DPPipeline([step]).fit(_li(spark, sf), list(_TWO), None, _KEY, MODE)
    return rounded(fitted.score(0.5, MODE).withColumn("mean_squared_distance", F.col("mean_squared_distance") / 1e6), 4)


@query("k_means_score", (
    f"with {_TRAIN}, {_trained(_kmeans_sql())}, v as (select {_IN[0]} as p, {_IN[1]} as q from t where not train), "
    + _distance_sql("least(" + ", ".join(
        f"(p - (25::double + 25::double * (select x from c3 where k = {k}))) ** 2 + (q - (50000::double + 50000::double * (select y from c3 where k = {k}))) ** 2" for k in range(3)) + ")", "v")))
def _(spark, sf):
    return _scored(spark, sf, _KM)


@query("pca_score", (
    f"with {_TRAIN}, {_trained(_pca_sql())}, o as (select {_IN[0]} - (25::double + norm * s0 / n) as p, {_IN[1]} - (50000::double + norm * s1 / n) as q, v0, v1 from t, k where not train), "
    + _distance_sql("p * p + q * q - (v0 * p + v1 * q) * (v0 * p + v1 * q)", "o")))
def _(spark, sf):
    return _scored(spark, sf, DPPCA(3.0, 1, _TWO))


def _bayes_sql(source: str, columns: list[str], epsilon: float) -> str:
    """Noisy accuracy on the test part of naive Bayes on scaled columns ``u0``, … of ``source``."""
    prims, names = ["count(*)::double as n"], ["n"]
    for i, u in enumerate(columns):
        prims += [f"{exact(u, 1.0)} as s{i}", f"{exact(f'{u} * {u}', 1.0)} as q{i}"]
        names += [f"s{i}", f"q{i}"]
    noisy = ", ".join(f"{c} + {lap(f'bayes|{c}', ['l_returnflag'], len(names) / epsilon)} as {c}" for c in names)
    return (f"g as (select l_returnflag, {', '.join(prims)} from {source} where train group by 1), b as (select l_returnflag, {noisy} from g), "
            f"y as (select id, {source}.l_returnflag as truth, b.l_returnflag as c, ln(b.n / (select sum(n) from b)) {' '.join(_score(i, u) for i, u in enumerate(columns))} as score "
            f"from {source}, b where not train), h as (select id, any_value(truth) as truth, arg_max(c, score) as guess from y group by id), "
            f"a as (select count(*)::double + {lap('score|rows', [], 4.0)} as n, {exact('(truth = guess)::int', 1.0)} + {lap('score|right', [], 4.0)} as k from h) "
            f"select {out('greatest(0, least(1, k / n))', 'accuracy')} from a")


_PC = (-60000.0, 60000.0)


@query("pca_then_bayes", (
    f"with {_TRAIN}, {_trained(_pca_sql())}, z as (select id, train, l_returnflag, (case when abs(v0) >= abs(v1) then sign(v0) else sign(v1) end) * "
    f"(v0 * (l_quantity - (25::double + norm * s0 / n)) + v1 * (l_extendedprice - (50000::double + norm * s1 / n))) as pc0 from t, k), " + _bayes_sql("z", [unit("pc0", *_PC)], 1.0)))
def _(spark, sf):
    fitted = DPPipeline([DPPCA(3.0, 1, _TWO), DPGaussianNB(1.0, {"pc0": _PC}, FLAGS)]).fit(_li(spark, sf), list(_TWO), "l_returnflag", _KEY, MODE)
    return rounded(fitted.score(0.5, MODE))


_FAR = {f"distance{k}": (0.0, 120000.0) for k in range(3)}


@query("k_means_then_bayes", (
    f"with {_TRAIN}, {_trained(_kmeans_sql())}, z as (select id, train, l_returnflag, " + ", ".join(
        f"sqrt(({_IN[0]} - (25::double + 25::double * (select x from c3 where k = {k}))) ** 2 + ({_IN[1]} - (50000::double + 50000::double * (select y from c3 where k = {k}))) ** 2) "
        f"as distance{k}" for k in range(3)) + " from t), " + _bayes_sql("z", [unit(c, *b) for c, b in _FAR.items()], 1.0)))
def _(spark, sf):
    fitted = DPPipeline([_KM, DPGaussianNB(1.0, _FAR, FLAGS)]).fit(_li(spark, sf), list(_TWO), "l_returnflag", _KEY, MODE)
    return rounded(fitted.score(0.5, MODE))


def _filled(c: str, bounds: tuple[float, float], scale: float) -> tuple[str, str]:
    """Noisy sums of a column with gaps, and the column with its gaps filled by their mean."""
    low, high = bounds
    sums = (f"{exact(f'case when {c} is null then 0::double else {unit(c, low, high)} end', 1.0)} + {lap(f'impute|s_{c}', [], scale)} as s_{c}, "
            f"{exact(f'({c} is not null)::int', 1.0)} + {lap(f'impute|n_{c}', [], scale)} as n_{c}")
    mean = f"case when n_{c} >= 1 then s_{c} / n_{c} else 0 end"
    return sums, f"coalesce({c}, {num((low + high) / 2.0)} + {num((high - low) / 2.0)} * least(1::double, greatest(-1::double, {mean}))) as {c}"


_SUMS, _FILLS = zip(*[_filled(c, b, 4.0) for c, b in _TWO.items()])


@query("chain_private_impute", (
    f"with l as (select l_orderkey, l_linenumber, l_returnflag, case when l_linenumber <> 3 then l_quantity end as l_quantity, "
    f"case when l_linenumber <> 2 then l_extendedprice end as l_extendedprice from lineitem), n0 as (select {', '.join(_SUMS)} from l), "
    f"z as (select row_number() over () as id, l_returnflag, {', '.join(_FILLS)}, {uni('split', _KEY, seed=1)} >= 0.2::double as train from l, n0), "
    + _bayes_sql("z", [QU, PU], 1.0)))
def _(spark, sf):
    gaps = _li(spark, sf).withColumns({"l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), "l_extendedprice": F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice"))})
    chain = DPPipeline([DPGaussianNB(1.0, _TWO, FLAGS)], imputer_epsilon=1.0)
    return rounded(chain.fit(gaps, list(_TWO), "l_returnflag", _KEY, MODE, imputer="mean").score(0.5, MODE))


# -- synthetic data ------------------------------------------------------------------------------------------------

_COLS = ["c_nationkey", "c_acctbal", "c_mktsegment"]
_CODES = ("c_nationkey as c_nationkey, least(9, floor((greatest(-1000::double, least(c_acctbal, 10000::double)) - -1000::double) / 11000::double * 10::double)::int) "
          "as c_acctbal, (list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1)::int as c_mktsegment")


@query("synth_encode", f"select {_CODES} from customer")
def _(spark, sf):
    return synth_encode(table(spark, sf, "customer"), CUSTOMER, _COLS).codes


@query("synth_decode", f"select c_nationkey, -1000::double + (c_acctbal + 0.5::double) * 1100::double as c_acctbal, ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][c_mktsegment + 1] as c_mktsegment from (select {_CODES} from customer)")
def _(spark, sf):
    encoded = synth_encode(table(spark, sf, "customer"), CUSTOMER, _COLS)
    return encoded.decode(encoded.codes)


@query("fidelity_report", f"""with a as (select {_CODES} from customer where c_custkey % 2 = 0), b as (select {_CODES} from customer where c_custkey % 2 = 1),
 la as (select 'c_nationkey' as "column", c_nationkey as code from a union all select 'c_acctbal', c_acctbal from a union all select 'c_mktsegment', c_mktsegment from a),
 lb as (select 'c_nationkey' as "column", c_nationkey as code from b union all select 'c_acctbal', c_acctbal from b union all select 'c_mktsegment', c_mktsegment from b),
 pa as (select "column", code, count(*)::double / (select count(*) from a) as p from la group by 1, 2), pb as (select "column", code, count(*)::double / (select count(*) from b) as p from lb group by 1, 2),
 d as (select "column", sum(abs(coalesce(pa.p, 0) - coalesce(pb.p, 0))) / 2 as distance from pa full join pb using ("column", code) group by 1)
 select "column", round(distance, 6) as distance, round(case "column" when 'c_acctbal' then (select avg(c_acctbal) from customer where c_custkey % 2 = 0) when 'c_nationkey' then (select avg(c_nationkey) from customer where c_custkey % 2 = 0) end, 6) as mean_a,
 round(case "column" when 'c_acctbal' then (select avg(c_acctbal) from customer where c_custkey % 2 = 1) when 'c_nationkey' then (select avg(c_nationkey) from customer where c_custkey % 2 = 1) end, 6) as mean_b,
 round(case "column" when 'c_acctbal' then (select var_samp(c_acctbal) from customer where c_custkey % 2 = 0) when 'c_nationkey' then (select var_samp(c_nationkey) from customer where c_custkey % 2 = 0) end, 3) as variance_a,
 round(case "column" when 'c_acctbal' then (select var_samp(c_acctbal) from customer where c_custkey % 2 = 1) when 'c_nationkey' then (select var_samp(c_nationkey) from customer where c_custkey % 2 = 1) end, 3) as variance_b from d""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    plan = synth_encode(c, CUSTOMER, _COLS).plan
    f = fidelity(c.filter("c_custkey % 2 = 0").select(*_COLS), c.filter("c_custkey % 2 = 1").select(*_COLS), plan)
    return f.select("column", F.round("distance", 6).alias("distance"), *[F.round(f"mean_{s}", 6).alias(f"mean_{s}") for s in "ab"],
                    *[F.round(f"variance_{s}", 3).alias(f"variance_{s}") for s in "ab"])
