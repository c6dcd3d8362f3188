"""SQL of the registered queries, for a database that has the same tables."""

from helixframe.functions.codons import BASES, GENES, GROUPS, HIGH_EXPRESSION, STOPS, TABLES
from helixframe.operators.generation import METHODS  # noqa: F401

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _aa(codon: str, table: int = 2) -> str:
    at = [f"instr('{BASES}', substr({codon}, {i}, 1))" for i in (1, 2, 3)]
    return f"substr('{TABLES[table]}', (16 * ({at[0]} - 1) + 4 * ({at[1]} - 1) + {at[2]})::INT, 1)"


RECORDS = f"""
WITH letters AS (SELECT doc_id, lang, source, regexp_replace(lower(text), '[^a-z]', '', 'g') AS l FROM documents),
pieces AS (SELECT doc_id, lang, source, piece, substr(l, piece * 300 + 1, 300) AS l FROM (SELECT *, unnest(range(0, (length(l) - 3) // 300 + 1)) AS piece FROM letters WHERE length(l) >= 3)),
raw AS (SELECT *, substr(translate(l, 'abcdefghijklmnopqrstuvwxyz', '{("ACGT" * 7)[:26]}'), 1, 3 * (length(l) // 3)) AS raw FROM pieces),
body AS (SELECT *, list_transform(range(0, length(raw) // 3), lambda i: CASE WHEN substr(raw, 3 * i + 1, 3) IN ({_IN(STOPS)}) THEN 'TTA' ELSE substr(raw, 3 * i + 1, 3) END) AS body FROM raw),
rec AS (SELECT doc_id * 10000000 + piece AS idx, 'REC' || doc_id || '_' || piece AS id,
  list_extract([{_IN(GENES)}], ((greatest(ascii(substr(l, 1, 1)) - 97, 0) + 3 * greatest(ascii(substr(l, 3, 1)) - 97, 0) + 7 * greatest(ascii(substr(l, 6, 1)) - 97, 0)) % 13 + 1)) AS gene_name,
  lang || '_' || source AS species, array_to_string(body, '') || 'TAA' AS sequence,
  array_to_string(list_transform(body, lambda c: {_aa("c")}), '') AS protein, list_append(body, 'TAA') AS codons,
  CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM body),
cod AS (SELECT idx, gene_name, species, split, unnest(codons) AS codon, unnest(range(1, len(codons) + 1)) AS pos FROM rec),
sense AS (SELECT *, {_aa("codon")} AS aa FROM cod WHERE codon NOT IN ({_IN(STOPS)})),
code AS (SELECT a || b || c AS codon, {_aa("a || b || c")} AS aa FROM (SELECT unnest(['A','C','G','T']) a), (SELECT unnest(['A','C','G','T']) b), (SELECT unnest(['A','C','G','T']) c)),
train_aa AS (SELECT aa, codon, count(*) AS n FROM sense WHERE split = 'train' GROUP BY ALL),
high_aa AS (SELECT aa, codon, count(*) AS n FROM sense WHERE split = 'train' AND gene_name IN ({_IN(HIGH_EXPRESSION)}) GROUP BY ALL),
weights AS (SELECT aa, codon, n, CASE WHEN m > 0 THEN n / m ELSE 1.0 / k END AS weight FROM (
  SELECT c.aa, c.codon, coalesce(h.n, 0) AS n, max(coalesce(h.n, 0)) OVER (PARTITION BY c.aa) AS m, count(*) OVER (PARTITION BY c.aa) AS k
  FROM code c LEFT JOIN high_aa h ON c.codon = h.codon WHERE c.aa <> '*')),
test AS (SELECT * FROM rec WHERE split = 'test'), train AS (SELECT * FROM rec WHERE split = 'train')
"""

_TOP = "SELECT aa, codon FROM {t} QUALIFY row_number() OVER (PARTITION BY aa ORDER BY n DESC, codon) = 1"
_FULL = "SELECT f.aa, coalesce(t.codon, f.first) AS codon FROM (SELECT aa, min(codon) AS first FROM code WHERE aa <> '*' GROUP BY aa) f LEFT JOIN ({t}) t ON t.aa = f.aa"
_STANDARD = f"""(SELECT {_aa("codon", 1)} AS aa, codon, count(*) AS n FROM cod WHERE split = 'train' AND codon NOT IN ({_IN(STOPS)}) GROUP BY ALL HAVING {_aa("codon", 1)} NOT IN ('*', 'X'))"""
_REMAP = f"SELECT aa, CASE WHEN aa = 'I' AND codon = 'ATA' THEN 'ATC' ELSE codon END AS codon FROM ({_FULL.format(t=_TOP.format(t=_STANDARD))})"
_LOOKUP = """SELECT t.idx, '{name}' AS method, string_agg(coalesce(m.codon, 'UNK'), '' ORDER BY t.pos) || 'TAA' AS generated
  FROM (SELECT idx, unnest(string_split(protein, '')) AS aa, unnest(range(1, length(protein) + 1)) AS pos FROM test) t LEFT JOIN ({table}) m ON m.aa = t.aa GROUP BY t.idx"""
_HASH = "('0x' || substr(md5({text}), 1, {n}))::BIGINT"
_RANDOM = f"""SELECT t.idx, 'random_synonymous' AS method, string_agg(list_extract(o.codons, {_HASH.format(text="'0:' || t.idx || ':' || t.pos", n=8)} % len(o.codons) + 1), '' ORDER BY t.pos)
  || list_extract(list_sort([{_IN(STOPS)}]), {_HASH.format(text="'0:' || t.idx || ':stop'", n=8)} % 4 + 1) AS generated
  FROM (SELECT idx, unnest(string_split(protein, '')) AS aa, unnest(range(0, length(protein))) AS pos FROM test) t
  JOIN (SELECT aa, list(codon ORDER BY codon) AS codons FROM code WHERE aa <> '*' GROUP BY aa) o ON o.aa = t.aa GROUP BY t.idx"""
GENERATED = RECORDS + f""",
gen AS ({_LOOKUP.format(name="mt_cai_lookup", table=_FULL.format(t=_TOP.format(t="high_aa")))}
  UNION ALL {_LOOKUP.format(name="most_frequent_codon", table=_FULL.format(t=_TOP.format(t="train_aa")))}
  UNION ALL {_LOOKUP.format(name="codontransformer_remap", table=_REMAP)}
  UNION ALL {_RANDOM}
  UNION ALL SELECT idx, 'natural_reference', sequence FROM test),
gc AS (SELECT idx, method, unnest(range(1, length(generated) // 3 + 1)) AS pos, substr(generated, 3 * unnest(range(1, length(generated) // 3 + 1)) - 2, 3) AS codon FROM gen),
cai AS (SELECT g.idx, g.method, exp(avg(ln(w.weight))) AS cai FROM gc g JOIN gen s ON g.idx = s.idx AND g.method = s.method JOIN weights w ON w.codon = g.codon
  WHERE w.weight > 0 AND g.pos <= length(s.generated) // 3 - 1 GROUP BY ALL),
grams AS (SELECT idx, method, n, array_to_string(list_slice(c, i, i + n - 1), '') AS gram FROM (
  SELECT idx, method, c, n, unnest(range(1, len(c) - n + 2)) AS i FROM (SELECT idx, method, list(codon ORDER BY pos) AS c FROM gc GROUP BY ALL), (SELECT unnest([1, 2, 3, 4]) AS n))),
gcount AS (SELECT idx, method, n, gram, count(*) AS k FROM grams GROUP BY ALL),
shares AS (SELECT h.idx, h.method, h.n, greatest(sum(least(h.k, coalesce(r.k, 0))) / sum(h.k), 1e-8) AS share FROM gcount h
  LEFT JOIN gcount r ON r.idx = h.idx AND r.n = h.n AND r.gram = h.gram AND r.method = 'natural_reference' GROUP BY ALL),
bleu AS (SELECT idx, method, exp(avg(ln(share))) AS bleu FROM shares GROUP BY ALL),
div AS (SELECT idx, method, -sum(p * log2(p)) AS diversity FROM (SELECT idx, method, n / sum(n) OVER (PARTITION BY idx, method) AS p FROM (SELECT idx, method, codon, count(*) AS n FROM gc GROUP BY ALL)) GROUP BY ALL),
comp AS (SELECT c.idx, c.method, NOT bool_or(c.codon IN ('TAA', 'TAG', 'AGA', 'AGG') AND c.pos < length(g.generated) // 3) AS complies FROM gc c JOIN gen g ON g.idx = c.idx AND g.method = c.method GROUP BY ALL),
met AS (SELECT g.idx, g.method, s.gene_name, s.species, c.cai, b.bleu, d.diversity,
  (length(generated) - length(translate(generated, 'GC', ''))) / length(generated) AS gc,
  CASE WHEN g.method <> 'natural_reference' THEN abs((length(generated) - length(translate(generated, 'GC', ''))) / length(generated) - (length(s.sequence) - length(translate(s.sequence, 'GC', ''))) / length(s.sequence)) END AS gc_delta,
  (g.generated NOT IN (SELECT sequence FROM train)) AS novel, p.complies
  FROM gen g JOIN test s ON s.idx = g.idx JOIN cai c ON c.idx = g.idx AND c.method = g.method JOIN bleu b ON b.idx = g.idx AND b.method = g.method JOIN div d ON d.idx = g.idx AND d.method = g.method JOIN comp p ON p.idx = g.idx AND p.method = g.method)
"""
PAIRS = RECORDS + """,
pairs AS (SELECT q.idx AS q_idx, t.idx AS t_idx, q.gene_name AS gene, t.species AS t_species, levenshtein(q.protein, t.protein) AS edit_distance,
  1 - levenshtein(q.protein, t.protein) / greatest(length(q.protein), length(t.protein), 1) AS identity, length(q.protein) AS ql, length(t.protein) AS tl
  FROM test q JOIN train t ON q.gene_name = t.gene_name AND q.idx <> t.idx),
best AS (SELECT q.idx, coalesce(max(p.identity), 0.0) AS identity FROM test q LEFT JOIN pairs p ON p.q_idx = q.idx GROUP BY q.idx)
"""
_BEST = PAIRS[len(RECORDS):]
MEASURED = GENERATED + _BEST
TRANSITIONS = RECORDS + """,
steps AS (SELECT split, codon AS "from", lead(codon) OVER (PARTITION BY idx ORDER BY pos) AS "to" FROM cod),
ta AS (SELECT "from", "to", count(*) AS n FROM steps WHERE split = 'train' AND "to" IS NOT NULL GROUP BY ALL),
tb AS (SELECT "from", "to", count(*) AS n FROM steps WHERE split = 'test' AND "to" IS NOT NULL GROUP BY ALL),
grid AS (SELECT a.codon AS "from", b.codon AS "to" FROM code a, code b),
pa AS (SELECT "from", "to", m / sum(m) OVER (PARTITION BY "from") AS p FROM (SELECT g."from", g."to", coalesce(n, 0) + 1e-3::DOUBLE AS m FROM grid g LEFT JOIN ta USING ("from", "to"))),
pb AS (SELECT "from", "to", m / sum(m) OVER (PARTITION BY "from") AS p FROM (SELECT g."from", g."to", coalesce(n, 0) + 1e-3::DOUBLE AS m FROM grid g LEFT JOIN tb USING ("from", "to")))
"""
_STRATUM = "CASE WHEN identity < 0.6 THEN '<60%' WHEN identity < 0.8 THEN '60-80%' WHEN identity < 0.9 THEN '80-90%' WHEN identity < 0.95 THEN '90-95%' WHEN identity < 1.01 THEN '>=95%' END"
_DIFF = """,
diff AS (SELECT a.idx, a.method, a.species, round(a.bleu - b.bleu, 9) AS d FROM met a JOIN met b ON a.idx = b.idx AND b.method = 'codontransformer_remap' WHERE a.method IN ('mt_cai_lookup', 'most_frequent_codon', 'random_synonymous'))"""

_SUMMARY = """SELECT method, count(*) AS n, round(avg(cai), 9) AS cai, round(avg(bleu), 9) AS bleu, round(avg(diversity), 9) AS diversity, round(avg(gc), 9) AS gc, round(coalesce(avg(gc_delta), 0), 9) AS gc_delta,
  round(stddev_pop(gc), 9) AS sd_gc, round(avg(novel::DOUBLE), 9) AS novelty, round(avg(complies::DOUBLE), 9) AS compliance FROM met GROUP BY method"""
_LONG = f""",
long AS (SELECT idx, method, species, stratum, metric, value FROM (SELECT m.idx, m.method, m.species, {_STRATUM} AS stratum,
  unnest(['bleu', 'cai', 'gc_delta', 'diversity']) AS metric, unnest([round(bleu, 9), round(cai, 9), round(gc_delta, 9), round(diversity, 9)]) AS value FROM met m JOIN (SELECT idx, round(identity, 9) AS identity FROM best) b ON b.idx = m.idx) WHERE value IS NOT NULL)"""


def _bootstrap(rows: str, by: str, value: str, draws: int, seed: int) -> str:
    """Means and intervals of rows (by..., species, value), whole species drawn."""
    keys = by.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""sums AS (SELECT {by}, species, sum({value}) AS s, count({value}) AS c FROM ({rows}) GROUP BY ALL),
      num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY species) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS k FROM sums),
      want AS (SELECT {by}, k, pos AS slot, unnest(range(0, {draws})) AS rep FROM num),
      reps AS (SELECT {", ".join(f"w.{k}" for k in keys)}, w.rep, sum(n.s) / sum(n.c) AS m FROM want w JOIN num n ON {on("n", "w")} AND n.pos = {_HASH.format(text=f"'{seed}:' || w.rep || ':' || w.slot", n=12)} % w.k GROUP BY ALL),
      mean AS (SELECT {by}, sum(s) / sum(c) AS mean, sum(c)::BIGINT AS n, count(*) AS clusters FROM sums GROUP BY ALL),
      ci AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY ALL)
      SELECT {", ".join(f"a.{k}" for k in keys)}, round(a.mean, 9) AS mean, a.n, a.clusters, round(r.lo, 9) AS lo, round(r.hi, 9) AS hi, (r.lo > 0 OR r.hi < 0) AS significant FROM mean a JOIN ci r ON {on("a", "r")}"""


SQL = {
    "lookup_tables": RECORDS + f""" SELECT 'mt_cai_lookup' AS name, aa, codon FROM ({_FULL.format(t=_TOP.format(t="high_aa"))}) UNION ALL SELECT 'most_frequent_codon', aa, codon FROM ({_FULL.format(t=_TOP.format(t="train_aa"))})
      UNION ALL SELECT 'tryptophan_only', aa, codon FROM ({_FULL.format(t=_TOP.format(t="(SELECT aa, codon, count(*) AS n FROM sense WHERE split = 'train' AND idx IN (SELECT idx FROM rec WHERE regexp_matches(protein, '^W+$')) GROUP BY ALL)"))})""",
    "constraint_table": RECORDS + f"""SELECT c.codon, c.aa, t.n AS residues, coalesce(u.n, 0) AS used FROM code c JOIN (SELECT {_aa("codon")} AS aa, count(*) AS n FROM cod WHERE split = 'test' GROUP BY 1) t ON t.aa = c.aa
      LEFT JOIN (SELECT codon, count(*) AS n FROM cod WHERE split = 'test' GROUP BY 1) u ON u.codon = c.codon""",
    "training_masks": RECORDS + """, d AS (SELECT idx, length(protein) AS n, unnest(range(0, length(protein))) AS i, ('0x' || substr(md5('42:' || idx || ':ratio'), 1, 8))::BIGINT AS u FROM train WHERE length(protein) > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY md5('42:' || idx || ':' || i), i) AS r FROM d)
      SELECT idx, string_agg(i::VARCHAR, ',' ORDER BY i) AS masked FROM r WHERE r <= greatest(1, ceil((u + 1) / 4294967296.0::DOUBLE * n)) GROUP BY idx""",
    "training_batches": RECORDS.replace("WITH ", "WITH RECURSIVE ", 1) + """, lens AS MATERIALIZED (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n) AS k FROM (SELECT (length(sequence) // 3)::BIGINT AS n FROM train) GROUP BY n),
      steps AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS b, 0::BIGINT AS room, 1::BIGINT AS size, 0::BIGINT AS nb, 0::BIGINT AS held UNION ALL
        SELECT k, n, b, room, size, CASE WHEN c <= room THEN b ELSE b + (c - room + size - 1) // size END, CASE WHEN c <= room THEN held + c ELSE (c - room - 1) % size + 1 END
        FROM (SELECT l.k, l.n, l.c, s.nb AS b, s.held, greatest(1, 8192 // greatest(l.n, 1)) AS size, CASE WHEN s.held > 0 THEN greatest(0, greatest(1, 8192 // greatest(l.n, 1)) - s.held) ELSE greatest(1, 8192 // greatest(l.n, 1)) END AS room FROM steps s JOIN lens l ON l.k = s.k + 1)),
      placed AS (SELECT idx, (length(sequence) // 3)::BIGINT AS n, row_number() OVER (PARTITION BY length(sequence) // 3 ORDER BY idx) - 1 AS i FROM train)
      SELECT CASE WHEN i < room THEN b ELSE b + 1 + (i - room) // size END AS batch, count(*) AS rows, sum(p.n)::BIGINT AS codons, count(*) * max(p.n) AS padded, min(idx) AS first FROM placed p JOIN steps s ON s.n = p.n AND s.k > 0 GROUP BY 1""",
    "augmented": RECORDS + f""", o AS MATERIALIZED (SELECT aa, codon, sum(weight) OVER (PARTITION BY aa ORDER BY codon) AS cum, sum(weight) OVER (PARTITION BY aa) AS total FROM weights WHERE weight > 0),
      d AS (SELECT t.idx, v, pos - 1 AS i, codon, {_aa("codon")} AS aa, ('0x' || substr(md5('42:' || t.idx || ':' || v || ':' || (pos - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM cod t, (SELECT unnest([0, 1]) AS v) WHERE t.split = 'train'),
      drawn AS (SELECT d.idx, d.v, d.i, min(o.codon) FILTER (o.cum > d.u * o.total) AS pick FROM d JOIN o ON o.aa = d.aa GROUP BY ALL),
      made AS (SELECT d.idx, d.v, string_agg(CASE WHEN d.i = 0 OR d.codon IN ({_IN(STOPS)}) THEN d.codon ELSE coalesce(p.pick, d.codon) END, '' ORDER BY d.i) AS sequence FROM d LEFT JOIN drawn p ON p.idx = d.idx AND p.v = d.v AND p.i = d.i GROUP BY ALL)
      SELECT idx, id, gene_name, species, sequence, protein || '*' AS protein_sequence, false AS is_augmented, NULL::VARCHAR AS source_id FROM train
      UNION ALL SELECT (SELECT max(idx) + 1 FROM train) + m.idx * 2 + m.v, t.id || '_v' || m.v, t.gene_name, t.species, m.sequence, t.protein || '*', true, t.id FROM made m JOIN train t ON t.idx = m.idx""",
    "guided_sequences": TRANSITIONS.replace("WITH ", "WITH RECURSIVE ", 1) + """, usage AS (SELECT c.codon, c.aa, coalesce(t.n, 0) + 1e-3 AS m FROM code c LEFT JOIN (SELECT codon, count(*) AS n FROM cod WHERE split = 'train' AND codon NOT IN ('TAA', 'TAG', 'AGA', 'AGG') GROUP BY 1) t ON t.codon = c.codon),
      score AS (SELECT '' AS prev, codon, aa, m / sum(m) OVER () AS p FROM usage UNION ALL SELECT a."from", a."to", c.aa, a.p FROM pa a JOIN code c ON c.codon = a."to"),
      choice AS MATERIALIZED (SELECT prev, aa, codon, ln(p / sum(p) OVER (PARTITION BY prev, aa)) AS v, length(regexp_replace(codon, '[AT]', '', 'g')) AS g FROM score),
      target AS MATERIALIZED (SELECT round(avg(length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence)), 6) AS t FROM train),
      tests AS MATERIALIZED (SELECT idx, protein FROM test),
      walk AS (SELECT idx, protein || '*' AS p, beta, 0::BIGINT AS pos, '' AS prev, 0::BIGINT AS gc, '' AS seq FROM tests, (VALUES (0.0::DOUBLE), (200.0::DOUBLE)) b(beta) UNION ALL
        SELECT idx, p, beta, pos, codon, gc, seq FROM (SELECT w.idx, w.p, w.beta, w.pos + 1 AS pos, c.codon, w.gc + c.g AS gc, w.seq || c.codon AS seq,
          row_number() OVER (PARTITION BY w.idx, w.beta ORDER BY c.v - w.beta * pow((w.gc + c.g) / (3.0::DOUBLE * (w.pos + 1)) - t, 2) DESC, c.codon) AS r
          FROM walk w JOIN choice c ON c.prev = w.prev AND c.aa = substr(w.p, w.pos + 1, 1), target WHERE w.pos < length(w.p)) WHERE r = 1),
      done AS (SELECT idx, beta, seq FROM walk WHERE pos = length(p))
      SELECT a.idx, a.seq AS greedy, b.seq AS guided FROM done a JOIN done b ON b.idx = a.idx AND a.beta = 0 AND b.beta > 0""",
    "organism_tables": RECORDS + """SELECT species, aa, codon FROM (SELECT species, aa, codon, count(*) AS n FROM sense WHERE split = 'train' AND species IN (SELECT species FROM train GROUP BY species HAVING count(*) >= 200) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY species, aa ORDER BY n DESC, codon) = 1""",
    "conditions": RECORDS + f"SELECT gene_name, count(*) AS n, 0 AS none, CASE WHEN gene_name = 'ND6' THEN 1 ELSE 0 END AS strand, list_position([{_IN(GENES)}], gene_name) - 1 AS gene FROM rec GROUP BY gene_name",
    "protein_inputs": """WITH p AS (SELECT item_id, regexp_replace(upper(replace(trim(text), 'ß', 'SS')), '[*]+$', '') AS p FROM benchmark), b AS (SELECT *, list_sort(list_distinct(list_filter(string_split(p, ''), lambda x: instr('ACDEFGHIKLMNPQRSTVWY*', x) = 0))) AS bad FROM p)
      SELECT item_id, sha256(p) AS protein_sha256, CASE WHEN length(p) = 0 THEN 'empty protein' WHEN length(p) > 700 THEN 'longer than 700' WHEN len(bad) > 0 THEN 'invalid residues: ' || array_to_string(bad, ',') END AS error FROM b""",
    "code_exactness": RECORDS + f"""SELECT gene_name, count(*) AS n, round(avg((t2 = protein)::INT), 9) AS own, round(avg((t1 = protein)::INT), 9) AS standard FROM (SELECT r.gene_name, r.protein,
      regexp_replace(string_agg({_aa("codon", 2)}, '' ORDER BY pos), '[*]+$', '') AS t2, regexp_replace(string_agg({_aa("codon", 1)}, '' ORDER BY pos), '[*]+$', '') AS t1
      FROM test r JOIN cod c ON c.idx = r.idx GROUP BY r.idx, r.gene_name, r.protein) GROUP BY gene_name""",
    "without_neighbours": RECORDS + """, near AS (SELECT DISTINCT q.idx FROM test q JOIN train t ON t.gene_name = q.gene_name AND t.idx <> q.idx
      WHERE 1 - levenshtein(q.protein, t.protein) / greatest(length(q.protein), length(t.protein), 1) <= 0.3)
      SELECT gene_name, count(*) FILTER (idx NOT IN (SELECT idx FROM near)) AS n, count(*) AS "of" FROM test GROUP BY gene_name""",
    "stratified_intervals": MEASURED + _LONG + """, rows AS (SELECT 'overall' AS stratum, method, metric, species, value FROM long WHERE metric IN ('bleu', 'cai') UNION ALL SELECT stratum, method, metric, species, value FROM long WHERE metric IN ('bleu', 'cai') AND stratum IS NOT NULL),
      kept AS (SELECT stratum, method, metric FROM rows GROUP BY ALL HAVING stratum = 'overall' OR (count(*) >= 2 AND count(DISTINCT species) >= 2)), """
      + _bootstrap("SELECT r.* FROM rows r SEMI JOIN kept k ON r.stratum = k.stratum AND r.method = k.method AND r.metric = k.metric", "stratum, method, metric", "value", 2000, 0).replace(", (r.lo > 0 OR r.hi < 0) AS significant", ""),
    "doubly_controlled_intervals": MEASURED + _DIFF + """, rows AS (SELECT n.bound, d.species, d.d FROM diff d JOIN (SELECT idx, round(identity, 9) AS identity FROM best) b ON b.idx = d.idx, (SELECT unnest([70, 80, 90]) AS bound) n WHERE d.method = 'most_frequent_codon' AND b.identity <= n.bound / 100), """
      + _bootstrap("SELECT * FROM rows WHERE bound IN (SELECT bound FROM rows GROUP BY bound HAVING count(*) >= 5)", "bound", "d", 10000, 20261008),
    "species_equality": RECORDS + """, l AS (SELECT count(*) AS n FROM (SELECT species FROM test EXCEPT SELECT species FROM train)), r AS (SELECT count(*) AS n FROM (SELECT species FROM train EXCEPT SELECT species FROM test))
      SELECT l.n AS left_only, r.n AS right_only, (l.n = 0 AND r.n = 0) AS same FROM l, r""",
    "sampled_order": RECORDS + "SELECT row_number() OVER (ORDER BY md5('42:' || idx), idx) - 1 AS pos, idx FROM test QUALIFY pos < 50",
    "positional_join": RECORDS + """SELECT o.pos, o.id, o.gene_name, b.item_id, b.value FROM (SELECT row_number() OVER (ORDER BY md5('42:' || idx), idx) - 1 AS pos, id, gene_name FROM test) o
      JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, length(text) AS value FROM benchmark) b ON b.pos = o.pos WHERE o.pos < 50""",
    "key_join": RECORDS + "SELECT gene_name, count(*) AS rows, sum(length(sequence))::BIGINT AS letters, sum(quality)::BIGINT AS good FROM labels l JOIN rec r ON r.id = 'REC' || l.doc_id || '_0' GROUP BY gene_name",
    "split_manifest": RECORDS + f"""SELECT g || '/' || s AS path, (g || '/' || s) IN (SELECT gene_name || '/' || split FROM rec) AS present FROM (SELECT unnest([{_IN(GENES)}]) AS g), (SELECT unnest(['train', 'val', 'test', 'calibration']) AS s)""",
    "best_epochs": """WITH e AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS epoch, round(avg(o_totalprice), 6) AS loss FROM orders GROUP BY ALL),
      b AS (SELECT o_orderpriority, epoch AS best_epoch, loss AS best_loss FROM e QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY loss, epoch) = 1)
      SELECT o_orderpriority, s.epochs, b.best_epoch, b.best_loss, s.last - b.best_epoch AS stood, (s.last - b.best_epoch >= 8 AND s.epochs > 8) AS stopped FROM b JOIN (SELECT o_orderpriority, count(*) AS epochs, max(epoch) AS last FROM e GROUP BY 1) s USING (o_orderpriority)""",
    "originals": RECORDS + "SELECT true AS original, count(*) AS rows, count(*) AS different FROM train UNION ALL SELECT false, 2 * count(*), 2 * count(*) FROM train",
    "golden_checks": RECORDS + """, a AS (SELECT 'records' AS label, count(*)::DOUBLE AS actual FROM rec UNION ALL SELECT 'species', count(DISTINCT species)::DOUBLE FROM rec UNION ALL SELECT 'gc', avg((length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence)) FROM rec)
      SELECT c.label, c.claimed, round(a.actual, 9) AS actual, c.tol, coalesce(abs(c.claimed - a.actual) <= c.tol, false) AS passed
      FROM (VALUES ('records', 46264.0::DOUBLE, 0.5::DOUBLE), ('species', 12.0, 100.0), ('gc', 0.5, 0.1), ('absent', 1.0, 1.0)) c(label, claimed, tol) LEFT JOIN a USING (label)""",
    "padded_proteins": RECORDS + """SELECT idx, array_to_string(list_slice(list_concat(list_transform(list_filter(string_split(protein, ''), lambda x: x <> ''), lambda x: instr('ACDEFGHIKLMNPQRSTVWY', x)), list_transform(range(0, 128), lambda x: 0)), 1, 128), ',') AS tokens FROM rec WHERE split = 'val'""",
    "survey_categories": f"""SELECT item_id, concat_ws(',', {", ".join(f"CASE WHEN {' OR '.join(f'instr(t, {k!r}) > 0' for k in keys)} THEN '{group}' END" for group, keys in GROUPS.items())}, CASE WHEN item_id % 2 = 0 THEN 'homology' END) AS groups
      FROM (SELECT item_id, array_to_string(regexp_split_to_array(lower(text), '\\W+'), ' ; ') AS t FROM benchmark)""",
    "records": RECORDS + "SELECT idx, id, gene_name, species, sequence, protein || '*' AS protein_sequence, split FROM rec",
    "sequence_measures": RECORDS + """SELECT r.idx, round((length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence), 9) AS gc,
      round(coalesce((length(replace(sequence, 'C', '')) - length(replace(sequence, 'G', ''))) / nullif(length(sequence) - length(translate(sequence, 'GC', '')), 0), 0.0), 9) AS skew,
      sha256(sequence) AS hash, instr(protein, '*') = 0 AS complies, round(d.diversity, 9) AS diversity
      FROM rec r JOIN (SELECT idx, -sum(p * log2(p)) AS diversity FROM (SELECT idx, n / sum(n) OVER (PARTITION BY idx) AS p FROM (SELECT idx, codon, count(*) AS n FROM cod GROUP BY ALL)) GROUP BY idx) d ON d.idx = r.idx""",
    "codon_usage": RECORDS + "SELECT codon, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 12) AS freq FROM cod GROUP BY codon",
    "codon_counts": RECORDS + "SELECT aa, codon, n FROM train_aa",
    "rscu_weights": RECORDS + "SELECT aa, codon, n, round(weight, 9) AS weight FROM weights",
    "gene_tables": RECORDS + "SELECT gene_name, aa, codon FROM (SELECT gene_name, aa, codon, count(*) AS n FROM sense WHERE split = 'train' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gene_name, aa ORDER BY n DESC, codon) = 1",
    "standard_remap": RECORDS + _REMAP,
    "adaptation_index": RECORDS + "SELECT c.idx, round(exp(avg(ln(w.weight))), 9) AS cai FROM cod c JOIN weights w ON w.codon = c.codon JOIN rec r ON r.idx = c.idx WHERE w.weight > 0 AND c.pos < len(r.codons) GROUP BY c.idx",
    "transition_counts": TRANSITIONS + 'SELECT "from", "to", n FROM ta',
    "transition_probabilities": TRANSITIONS + 'SELECT "from", "to", round(p, 9) AS p FROM pa',
    "transition_divergence": TRANSITIONS + """SELECT round(sum(w * a.p * ln(a.p / b.p)), 9) AS kl FROM pa a JOIN pb b USING ("from", "to") JOIN (SELECT "from", sum(n) / sum(sum(n)) OVER () AS w FROM ta GROUP BY "from") s USING ("from")""",
    "transition_chi2": TRANSITIONS + """SELECT round(sum(x), 6) AS chi2, sum(d)::BIGINT AS dof, sum(n)::BIGINT AS n, round(sqrt(sum(x) / sum(n)), 9) AS cohens_w FROM (
      SELECT "from", sum((nb - e) * (nb - e) / e) AS x, count(*) - 1 AS d, max(rb) AS n FROM (
        SELECT p."from", p."to", coalesce(b.n, 0) AS nb, r.rb, p.p * r.rb AS e FROM pa p
        JOIN (SELECT "from", sum(n) AS rb FROM tb GROUP BY "from" HAVING sum(n) >= 5) r USING ("from") LEFT JOIN tb b USING ("from", "to"))
      WHERE e > 1e-6 GROUP BY "from") WHERE d > 0""",
    "generated": GENERATED + "SELECT idx, method, generated FROM gen",
    "sequence_scores": GENERATED + "SELECT idx, method, round(cai, 9) AS cai, round(bleu, 9) AS bleu, round(diversity, 9) AS diversity, round(gc, 9) AS gc, round(gc_delta, 9) AS gc_delta, novel, complies FROM met",
    "method_summary": GENERATED + _SUMMARY,
    "best_methods": GENERATED + f"SELECT method, bleu, row_number() OVER (ORDER BY bleu DESC, method) AS place FROM ({_SUMMARY}) WHERE method <> 'natural_reference'",
    "report_lines": GENERATED + f"""SELECT method, concat_ws(' & ', CASE method WHEN 'mt_cai_lookup' THEN 'Lookup' WHEN 'most_frequent_codon' THEN 'Most frequent' ELSE method END, printf('%+.4f', bleu), printf('%+.4f', cai)) AS line FROM ({_SUMMARY})""",
    "merged_metrics": GENERATED + f"SELECT method, unnest(['cai', 'bleu', 'gc']) AS metric, unnest([cai, -1.0, gc]) AS value FROM ({_SUMMARY})",
    "novel_sequences": RECORDS + "SELECT idx FROM test WHERE sequence NOT IN (SELECT sequence FROM train)",
    "top_neighbours": PAIRS + "SELECT q_idx, t_idx, t_species, edit_distance, round(identity, 9) AS identity, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY edit_distance, t_idx) - 1 AS rank FROM pairs) WHERE rank < 5",
    "capped_neighbours": PAIRS + "SELECT q_idx, t_idx, edit_distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY edit_distance, t_idx) - 1 AS rank FROM pairs WHERE identity <= 0.9) WHERE rank < 3",
    "max_identity": PAIRS + "SELECT idx, round(identity, 9) AS max_identity FROM best",
    "nearest_identity": PAIRS + "SELECT q_idx, t_idx, round(identity, 9) AS identity FROM pairs QUALIFY row_number() OVER (PARTITION BY q_idx ORDER BY identity DESC, t_idx) = 1",
    "threshold_pairs": PAIRS + "SELECT q_idx, t_idx, edit_distance FROM pairs WHERE edit_distance <= trunc(ql * (1.0::DOUBLE - 0.7::DOUBLE))",
    "kmer_candidates": RECORDS + """, km AS (SELECT DISTINCT idx, gene_name, split, substr(protein, i::INT, 3) AS kmer FROM (SELECT idx, gene_name, split, protein, unnest(range(1, length(protein) - 1)) AS i FROM rec)),
      v AS (SELECT q_idx, t_idx, votes, row_number() OVER (PARTITION BY q_idx ORDER BY votes DESC, t_idx) - 1 AS rank FROM (
        SELECT q.idx AS q_idx, t.idx AS t_idx, count(*) AS votes FROM km q JOIN km t USING (gene_name, kmer) WHERE q.split = 'test' AND t.split = 'train' GROUP BY ALL))
      SELECT q_idx, t_idx, votes, rank FROM v WHERE rank < 8 UNION ALL SELECT q.idx, t.idx, 0, t.r FROM test q JOIN (SELECT idx, gene_name, row_number() OVER (PARTITION BY gene_name ORDER BY idx) - 1 AS r FROM train) t ON t.gene_name = q.gene_name AND t.r < 8 WHERE q.idx NOT IN (SELECT q_idx FROM v)""",
    "identity_spread": PAIRS + """SELECT r.gene_name, count(*) AS n, round(avg(identity), 9) AS mean, round(median(identity), 9) AS median, round(quantile_cont(identity, 0.1), 9) AS p10, round(quantile_cont(identity, 0.9), 9) AS p90,
      round(quantile_cont(identity, 0.95), 9) AS p95, round(min(identity), 9) AS min, round(max(identity), 9) AS max, round(stddev_samp(identity) / sqrt(count(*)), 9) AS sem FROM best b JOIN rec r ON r.idx = b.idx GROUP BY r.gene_name""",
    "identity_histogram": PAIRS + "SELECT least(floor((identity - 0.3) / (0.7 / 49) + 1e-9)::BIGINT + 1, 49) AS bin, count(*) AS n FROM best WHERE identity >= 0.3 AND identity <= 1.0 GROUP BY bin",
    "stratified_scores": MEASURED + _LONG + """SELECT CASE WHEN grouping(stratum) = 1 THEN 'overall' ELSE stratum END AS stratum, method, metric, count(value) AS n, count(DISTINCT species) AS species, round(avg(value), 9) AS mean FROM long
      GROUP BY GROUPING SETS ((method, metric), (stratum, method, metric)) HAVING grouping(stratum) = 1 OR (stratum IS NOT NULL AND count(value) >= 2 AND count(DISTINCT species) >= 2)""",
    "bootstrap_interval": GENERATED + _DIFF + ", " + _bootstrap("SELECT * FROM diff", "method", "d", 2000, 0),
    "signed_rank": GENERATED + _DIFF + """, k AS (SELECT *, abs(d) AS a FROM diff WHERE d <> 0),
      r AS (SELECT *, count(*) OVER (PARTITION BY method, a) AS t, rank() OVER (PARTITION BY method ORDER BY a) + (count(*) OVER (PARTITION BY method, a) - 1) / 2 AS r, row_number() OVER (PARTITION BY method ORDER BY a, idx) AS o FROM k),
      s AS (SELECT method, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, sum(CASE WHEN d > 0 THEN o ELSE 0 END) AS op, sum(CASE WHEN d < 0 THEN o ELSE 0 END) AS om, sum(t * t - 1) AS ties FROM r GROUP BY method)
      SELECT method, n, round(least(wp, wm), 6) AS statistic, round((op - om) / (op + om), 9) AS effect, round((least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) AS z FROM s""",
    "rank_correlation": MEASURED + """SELECT method, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM (SELECT m.method, rank() OVER (PARTITION BY m.method ORDER BY round(b.identity, 9)) + (count(*) OVER (PARTITION BY m.method, round(b.identity, 9)) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY m.method ORDER BY round(m.bleu, 9)) + (count(*) OVER (PARTITION BY m.method, round(m.bleu, 9)) - 1) / 2 AS ry FROM met m JOIN best b ON b.idx = m.idx WHERE m.method <> 'natural_reference') GROUP BY method""",
    "gene_signed_rank": GENERATED.replace("WITH ", "WITH RECURSIVE ", 1) + _DIFF + """, gd AS (SELECT f.method, r.gene_name, round(avg(f.d), 9) AS d FROM diff f JOIN rec r ON r.idx = f.idx GROUP BY ALL),
      gr AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY method, abs(d)) AS t FROM gd WHERE d <> 0),
      gs AS (SELECT method, count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w, max(t) AS t, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM gr GROUP BY method),
      gz AS (SELECT method, count(*) FILTER (d = 0) AS zeros, bool_and(abs(d) <= 1e-8) AS identical FROM gd GROUP BY method),
      subsets(k, s) AS (SELECT 0, 0 UNION ALL SELECT k + 1, s + x * (k + 1) FROM subsets, (VALUES (0), (1)) v(x) WHERE k < 13),
      gt AS (SELECT gz.method, coalesce(gs.n, 0) AS n, CASE WHEN identical THEN 0.0 ELSE least(up, down) END AS statistic, NOT identical AND zeros = 0 AND t = 1 AND gs.n <= 50 AS exact FROM gz LEFT JOIN gs USING (method))
      SELECT method, n, statistic, exact, CASE WHEN exact THEN round(least(1.0, 2.0 * (SELECT count(*) FROM subsets WHERE k = gt.n AND s <= gt.statistic) / (1 << gt.n::INT)), 12) END AS p FROM gt""",
    "gene_rollup": GENERATED + _DIFF + """, g AS (SELECT r.gene_name, f.d FROM diff f JOIN rec r ON r.idx = f.idx WHERE method = 'most_frequent_codon')
      SELECT coalesce(gene_name, 'pooled') AS gene_name, count(*) AS n, round(avg(d), 9) AS mean, round(avg((d > 0)::INT), 9) AS wins FROM g GROUP BY ROLLUP (gene_name)
      UNION ALL SELECT 'pooled without ND6', count(*), round(avg(d), 9), round(avg((d > 0)::INT), 9) FROM g WHERE gene_name <> 'ND6'""",
    "gene_skew": RECORDS + """SELECT gene_name, CASE WHEN gene_name = 'ND6' THEN 'L' ELSE 'H' END AS strand, count(*) AS n, round(avg(coalesce((length(replace(sequence, 'C', '')) - length(replace(sequence, 'G', ''))) / nullif(length(sequence) - length(translate(sequence, 'GC', '')), 0), 0)), 9) AS skew FROM rec GROUP BY ALL""",
    "skew_pivot": GENERATED + """, s AS (SELECT t.gene_name, g.method, (length(replace(generated, 'C', '')) - length(replace(generated, 'G', ''))) / nullif(length(generated) - length(translate(generated, 'GC', '')), 0) AS v FROM gen g JOIN test t ON t.idx = g.idx WHERE t.gene_name IN ('ND6', 'ND4', 'ATP8', 'ND5'))
      SELECT gene_name, round(avg(CASE WHEN method = 'natural_reference' THEN v END), 9) AS natural_reference, round(avg(CASE WHEN method = 'most_frequent_codon' THEN v END), 9) AS most_frequent_codon, round(avg(CASE WHEN method = 'random_synonymous' THEN v END), 9) AS random_synonymous FROM s GROUP BY gene_name""",
    "species_overlap": RECORDS + """SELECT 'shared' AS part, count(*) AS n FROM (SELECT species FROM test INTERSECT SELECT species FROM train)
      UNION ALL SELECT 'test_only', count(*) FROM (SELECT species FROM test EXCEPT SELECT species FROM train) UNION ALL SELECT 'train_only', count(*) FROM (SELECT species FROM train EXCEPT SELECT species FROM test)""",
    "doubly_controlled": PAIRS + """SELECT bound, count(*) AS n, count(DISTINCT r.species) AS species FROM best b JOIN rec r ON r.idx = b.idx, (SELECT unnest([0.7, 0.8, 0.9]) AS bound)
      WHERE b.identity <= bound::DOUBLE GROUP BY bound HAVING count(*) >= 5""",
    "merged_tokens": RECORDS + """SELECT idx, array_to_string(list_transform(range(1, length(protein) + 1), lambda i: lower(substr(protein, i::INT, 1)) || '_' || lower(codons[i])), ' ') AS tokens FROM test""",
    "holdout": RECORDS + f"""SELECT species, idx FROM (SELECT species, idx, row_number() OVER (PARTITION BY species ORDER BY md5('42:' || idx)) AS r, greatest(1, floor(count(*) OVER (PARTITION BY species) * 0.1)) AS m FROM rec) WHERE r <= m""",
    "split_sizes": RECORDS + "SELECT g.gene_name, s.split, count(r.idx) AS n FROM (SELECT unnest([" + _IN(GENES) + "]) AS gene_name) g CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) s LEFT JOIN rec r ON r.gene_name = g.gene_name AND r.split = s.split GROUP BY ALL",
    "seed_summary": RECORDS + """, v AS (SELECT gene_name, split, avg((length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence)) AS gc FROM rec GROUP BY ALL)
      SELECT split, count(gc) AS n, round(avg(gc), 9) AS mean, round(stddev_samp(gc), 9) AS sd, round(min(gc), 9) AS min, round(max(gc), 9) AS max, count_if(gc > 0) AS positive FROM v GROUP BY split""",
    "paired_seeds": RECORDS + """, v AS (SELECT gene_name, split, avg((length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence)) AS gc FROM rec GROUP BY ALL),
      d AS (SELECT a.gc - b.gc AS d FROM v a JOIN v b ON a.gene_name = b.gene_name WHERE a.split = 'test' AND b.split = 'train')
      SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d), 9) AS sd, round(stddev_samp(d) / sqrt(count(*)), 9) AS sem, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d""",
    "running_best": """WITH e AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS epoch, avg(o_totalprice) AS loss FROM orders GROUP BY 1),
      b AS (SELECT *, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
      f AS (SELECT *, (before IS NULL OR loss < before) AS better, sum((before IS NULL OR loss < before)::INT) OVER (ORDER BY epoch) AS island FROM b)
      SELECT epoch, round(loss, 6) AS loss, better, (row_number() OVER (PARTITION BY island ORDER BY epoch) - 1)::BIGINT AS stale FROM f""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
