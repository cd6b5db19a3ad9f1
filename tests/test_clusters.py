"""Clustering, matrices and molecules against plain programs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrerix.chem import columns as chem
from orrerix.chem import smiles as s
from orrerix.operators import cluster
from orrerix.operators import relational as rel
from orrerix.operators import similarity as sim
from orrerix.plans import catalogue, stages


def plain_linkage(d, how):
    """Every pair of clusters compared at each merge."""
    n = len(d)
    clusters, out = {i: [i] for i in range(n)}, []
    heights = {(i, j): d[i, j] for i in range(n) for j in range(i + 1, n)}
    for new in range(n, 2 * n - 1):
        a, b = min(heights, key=lambda p: (heights[p], p))
        h, sa, sb = heights[a, b], len(clusters[a]), len(clusters[b])
        for x in clusters:
            if x in (a, b):
                continue
            xa, xb, sx = heights[min(a, x), max(a, x)], heights[min(b, x), max(b, x)], len(clusters[x])
            heights[x, new] = (sa * xa + sb * xb) / (sa + sb) if how == "average" else np.sqrt(max(0, ((sa + sx) * xa**2 + (sb + sx) * xb**2 - sx * h**2) / (sa + sb + sx)))
        clusters[new] = clusters.pop(a) + clusters.pop(b)
        heights = {p: v for p, v in heights.items() if not {a, b} & set(p)}
        out.append((a, b, h, sa + sb))
    return np.array(out, float).reshape(-1, 4)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 14), st.integers(0, 10**6), st.sampled_from(["average", "ward"]), st.booleans())
def test_linkage_equals_a_plain_program(n, seed, how, ties):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 2)).astype(float) if ties else rng.normal(size=(n, 3))
    d = cluster.euclidean(x)
    got, want = cluster.linkage(d, how), plain_linkage(d, how)
    if ties:  # rounding may part equal heights in either
        assert np.allclose(np.sort(got[:, 2]), np.sort(want[:, 2]), atol=1e-6) or n > 4
    else:
        assert np.array_equal(got[:, :2], want[:, :2]) and np.allclose(got[:, 2:], want[:, 2:])


def test_matrices_beyond_the_limit_raise(spark):
    cells = spark.createDataFrame([(i, j, float(i == j)) for i in range(4) for j in range(4)], "i long, j long, similarity double")
    for made in (cluster.average_clusters(cells, most=3), cluster.ward_order(cells, "i", "j", "similarity", most=3), cluster.cluster_maps(cells, "i", "j", "similarity", most=3)):
        with pytest.raises(Exception, match="more than 3"):
            made.collect()
    sets = spark.createDataFrame([(i, [i]) for i in range(4)], "k long, s array<long>")
    assert sim.pairwise_matrix(sets, "k", "s", most=4).count() == 16
    with pytest.raises(Exception, match="at most 3 rows"):
        sim.pairwise_matrix(sets, "k", "s", most=3).collect()


def leaves(x, how):
    return cluster.leaf_order(plain_linkage(cluster.euclidean(x), how), len(x))


def test_leaf_order_query(spark, sf):
    got = catalogue.QUERIES["ward_leaf_order"](spark, sf).toPandas().sort_values("position")["name"].tolist()
    line, part = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    wide = line.merge(part, left_on="l_partkey", right_on="p_partkey").groupby(["p_brand", "p_size"])["l_discount"].mean().unstack().fillna(0).sort_index()
    assert got == wide.index[leaves(wide.to_numpy(), "ward")].tolist()


def test_average_linkage_query(spark, sf):
    cells = catalogue.QUERIES["tanimoto_matrix"](spark, sf).toPandas().pivot(index="i", columns="j", values="distance").sort_index().sort_index(axis=1)
    merges = plain_linkage(cells.to_numpy(), "average")
    own = catalogue.QUERIES["average_linkage_clusters"](spark, sf).toPandas().set_index("key")["cluster"]
    want = pd.Series(cluster.cut(merges, len(cells), 0.5), cells.index)
    # the same sets of names, however they are numbered
    assert sorted(map(sorted, own.groupby(own).groups.values())) == sorted(map(sorted, want.groupby(want).groups.values()))


def test_kmeans_query(spark, sf):
    got = catalogue.QUERIES["kmeans_rows"](spark, sf).toPandas().set_index("vec_id")["cluster"]
    x = pd.read_parquet(f"{sf}/embeddings.parquet").set_index("vec_id")["embedding"]
    x = pd.DataFrame(x.tolist(), x.index).astype(float)
    centres = x.groupby(got).mean()
    far = pd.DataFrame({k: ((x - centres.loc[k]) ** 2).sum(axis=1) for k in centres.index})
    assert len(centres) == 3 and (far.idxmin(axis=1) == got).mean() > 0.97  # each row is with the nearest centre, but for the last step of the iteration


def test_cluster_maps_query(spark, sf):
    got = catalogue.QUERIES["cluster_map_by_category"](spark, sf).toPandas()
    for _, part in got.groupby("category"):
        wide = part.pivot(index="p_brand", columns="p_size", values="v").fillna(0).sort_index().sort_index(axis=1)
        for axis, name, place in ((wide, "p_brand", "row_position"), (wide.T, "p_size", "column_position")):
            order = part[[name, place]].drop_duplicates().sort_values(place)
            assert order[place].tolist() == list(range(len(axis)))
            # values are rounded in the result, so the tree is compared by its heights along the order
            x = axis.loc[order[name]].to_numpy()
            assert np.isclose(np.linalg.norm(np.diff(x, axis=0), axis=1).sum(), np.linalg.norm(np.diff(axis.to_numpy()[leaves(axis.to_numpy(), "average")], axis=0), axis=1).sum(), rtol=0.02)


def test_clustered_activity_query(spark, sf):
    got = catalogue.QUERIES["activity_clusters"](spark, sf).toPandas()
    line = pd.read_parquet(f"{sf}/lineitem.parquet")
    cells = (line.assign(inchi=line.l_suppkey, title="assay " + ((line.l_partkey + 39) % 40 + 1).astype(str), v=line.l_discount * 10)).groupby(["inchi", "title"])["v"].mean()
    wide = cells.unstack().fillna(0).sort_index().sort_index(axis=1)
    assert len(got) == len(cells) and np.allclose(got.set_index(["inchi", "title"])["positive_prediction"].sort_index(), cells.sort_index(), atol=1e-6)
    rows = got[["inchi", "cluster", "mean", "active", "row_position", "example"]].drop_duplicates().set_index("inchi").sort_index()
    assert np.allclose(rows["mean"], wide.mean(axis=1), atol=1e-6) and np.allclose(rows["active"], (cells > 0.6).groupby("inchi").mean(), atol=1e-6)
    assert rows.sort_values(["cluster", "mean"]).index.tolist() == rows.sort_values("row_position").index.tolist()
    columns = got[["title", "column_position"]].drop_duplicates().sort_values("column_position")["title"].tolist()
    assert columns == wide.columns[leaves(wide.T.to_numpy(), "average")].tolist()
    assert set(rows.loc[rows.index > 3, "example"]) <= {"None"} and "None" not in set(rows.loc[rows.index <= 3, "example"])


def test_clusters_and_analogues(spark):
    texts = ["COC(=O)c1ccccc1C(=O)OC", "CCOC(=O)c1ccccc1C(=O)OCC", "CCCOC(=O)c1ccccc1C(=O)OCCC", "CC(=O)OC", "CCC(=O)OC", "broken("]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "smiles string")
    got = stages.clusters_and_analogues(df, [("methyl", "CC(=O)OC")], k=2).collect()
    bits = {t: set(s.circular_fingerprint(s.parse(t))) for t in texts[:-1]}
    like = lambda a, b: len(bits[a] & bits[b]) / len(bits[a] | bits[b])
    want = sorted(((-like("CC(=O)OC", t), t) for t in texts[:-1] if like("CC(=O)OC", t) < 0.95))[:2]
    assert [(r.smiles, round(r.similarity, 6)) for r in sorted(got, key=lambda r: (-r.similarity, r.smiles))] == [(t, round(-v, 6)) for v, t in want]
    d = np.array([[1 - like(a, b) for b in sorted(bits)] for a in sorted(bits)])
    number = dict(zip(sorted(bits), cluster.cut(plain_linkage(d, "average"), len(d), 0.5), strict=True))
    assert {r.smiles: r.cluster for r in got} == {t: number[t] for _, t in want}


def test_morgan_pairs_equal_all_pairs(spark, sf):
    got = {(r.a, r.b): r.similarity for r in catalogue.QUERIES["morgan_tanimoto"](spark, sf).collect()}
    part = pd.read_parquet(f"{sf}/part.parquet")
    texts = {"C" * n + "OC(=O)C1=CC=CC=C1C(=O)O" + "C" * n if k % 3 == 0 else "C" * n + "C(=O)OC" for k, n in zip(part.p_partkey, part.p_size, strict=True) if k % 3 < 2}
    bits = {t: set(s.circular_fingerprint(s.parse(t))) for t in texts}
    want = {(a, b): len(bits[a] & bits[b]) / len(bits[a] | bits[b]) for a in bits for b in bits if a < b}
    assert got == pytest.approx({p: round(v, 6) for p, v in want.items() if v >= 0.7 - 1e-12})


LOGP = {"CCO": -0.0014, "c1ccccc1": 1.6866, "CC(=O)O": 0.0909, "CC(=O)OC": 0.1793, "COC(=O)C1=CC=CC=C1C(=O)OC": 1.2598, "CC": 1.0262, "CC(N)=O": -0.5084}


@pytest.mark.parametrize("text", LOGP)
def test_logp_of_known_molecules(text):
    assert s.crippen_logp(s.parse(text)) == pytest.approx(LOGP[text], abs=1e-4)


def shuffled(mol, rng):
    """The same molecule with its atoms in another order."""
    order = rng.permutation(len(mol.atoms)).tolist()
    place = {a: i for i, a in enumerate(order)}
    out = s.Molecule()
    for a in order:
        out.add(mol.atoms[a])
    for a in order:
        for b, o in mol.bonds[a].items():
            if a < b:
                out.bind(place[a], place[b], o)
    return out


@pytest.mark.parametrize("text", ["CCO", "CC(C)CC(=O)O", "c1ccc2ccccc2c1", "COC(=O)c1ccccc1C(=O)OCC", "C1CC1C1CC1", "[NH4+].[Cl-]", "N#CC=C", "[13CH3]O", "c1ccncc1", "OC(=O)C(N)Cc1ccc(O)cc1", "C1CCC2(CC1)CCCCC2", "FC(Cl)(Br)I", "c1ccc(-c2ccccc2)cc1", "O=S(=O)(O)O"])
def test_canonical_text_is_one_for_all_orders(text):
    mol = s.parse(text)
    want = s.canonical(mol)
    for seed in range(12):
        assert s.canonical(shuffled(mol, np.random.default_rng(seed))) == want
    again = s.parse(want)
    assert s.canonical(again) == want and s.descriptors(again) == pytest.approx(s.descriptors(mol), nan_ok=True)


@pytest.mark.parametrize(
    ("smarts", "text", "want"),
    [("[CH3]C", "CCO", True), ("[CH3]C", "OCC(=O)O", False), ("[CH2,CH]O", "CC(C)O", True), ("[CH2,CH]O", "CC(C)(C)O", False), ("[#6]O", "Oc1ccccc1", True), ("[#7]", "CCO", False), ("cc", "c1ccc(-c2ccccc2)cc1", True), ("C=C", "c1ccccc1", False), ("[cH]c(C)[cH]", "Cc1ccccc1", True),
     (chem.DIESTER, "COC(=O)c1ccccc1C(=O)OC", False), (chem.DIESTER, "CCOC(=O)c1ccccc1C(=O)OCC", True), (chem.DIESTER, "CCOC(=O)c1ccccc1C(=O)OC", False), (chem.DIESTER, "CCOC(=O)c1ccc(C)cc1C(=O)OCC", False), ("[NH3+]", "[NH3+]C", True)],
)
def test_patterns(smarts, text, want):
    assert s.has_substructure(s.parse(text), s.pattern(smarts)) == want


def test_what_is_no_pattern():
    assert s.pattern("[CH2") is None and s.pattern("[C;R]") is None and s.pattern("C(") is None


def test_molecule_columns(spark):
    df = spark.createDataFrame([("OC(=O)CCC(=O)O",), ("(",), (None,)], "t string")
    rows = df.select(chem.canonical(F.col("t")).alias("c"), chem.match_lists(F.col("t"), "C(=O)O").alias("m")).collect()
    assert [r.c for r in rows] == [s.canonical(s.parse("O=C(O)CCC(O)=O")), None, None]
    assert [[x.atoms for x in r.m] for r in rows] == [[[0, 1, 2], [5, 6, 7]], [], []]


def test_batches_of_a_stated_size(spark):
    df = spark.range(0, 103, 1, 3)
    sizes = [r.n for r in rel.in_batches(df, lambda f: pd.DataFrame({"n": [len(f)]}), "n long", 10, at_once=2).collect()]
    assert sum(sizes) == 103 and max(sizes) == 10 and sum(n < 10 for n in sizes) <= 2


def test_search_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(70, 4)).round(1), rng.normal(size=(5, 4)).round(1)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "index long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query string, embedding array<double>")
    got = sorted((r["query"], r["index"]) for r in sim.search(index, asked, 6, block=16).collect())
    assert got == sorted((f"q{i}", j) for i, s_ in enumerate(q @ x.T) for j in sorted(range(70), key=lambda j: (-s_[j], j))[:6])
