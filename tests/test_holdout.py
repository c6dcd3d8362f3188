"""Holdouts by counts of hashes, and baselines in one pass."""

from collections import defaultdict
from hashlib import md5

from helixframe.functions import codons as C
from helixframe.operators import clustering, generation


def test_few_rows_are_ranked(spark, monkeypatch):
    rows = [("large", k) for k in range(30_000)] + [("small", k) for k in range(7)] + [("one", 5)] + [("some", 3 * k) for k in range(95)]
    groups, ranked = defaultdict(list), []
    for g, k in rows:
        groups[g].append((md5(f"42:{k}".encode()).hexdigest(), k))
    want = sorted((g, k) for g, x in groups.items() for _, k in sorted(x)[: max(1, len(x) // 10)])
    before = clustering.positions
    monkeypatch.setattr(clustering, "positions", lambda df, *a: ranked.append(df.count()) or before(df, *a))
    got = clustering.hash_holdout(spark.createDataFrame(rows, "species string, idx long"), "species")
    assert got.columns == ["species", "idx"] and sorted(map(tuple, got.collect())) == want
    assert ranked[0] < 50


def test_baselines_of_odd_proteins_in_one_pass(spark, tmp_path):
    train = spark.createDataFrame([("COX1", "ATGAAATAA"), ("ND1", "ATGAAGTAA")], "gene_name string, sequence string")
    proteins = {1: "MWKLLSSRX", 2: "", 3: None, 4: "MéK日W", None: "LLL*", 7: "acd"}
    spark.createDataFrame([(k, p, "ATG") for k, p in proteins.items()], "idx long, protein string, sequence string").write.parquet(str(tmp_path / "t"))
    made = generation.generate_all(spark.read.parquet(str(tmp_path / "t")), train, spark)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    table = defaultdict(list)
    for k, a in enumerate(C.TABLES[2]):
        table[a].append(C.BASES[k // 16] + C.BASES[k // 4 % 4] + C.BASES[k % 4])

    def drawn(idx, key, options):
        head = ":".join(str(x) for x in (0, idx, key) if x is not None)
        return options[int(md5(head.encode()).hexdigest()[:8], 16) % len(options)]

    known = {a: sorted(c) for a, c in table.items() if a != "*"}
    most = {a: c[0] for a, c in known.items()} | {"M": "ATG"}
    for r in made.collect():
        p = proteins[r.idx]
        if r.method == "natural_reference":
            assert r.generated == "ATG"
        elif p is None:
            assert r.generated is None
        elif r.method == "random_synonymous":
            assert r.generated == "".join(drawn(r.idx, k, known.get(a, ["NNN"])) for k, a in enumerate(p)) + drawn(r.idx, "stop", sorted(C.STOPS))
        elif r.method == "mt_cai_lookup":
            assert r.generated == "".join(most.get(a, "UNK") for a in p) + "TAA"
