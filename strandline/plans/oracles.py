"""The queries in DuckDB's SQL, written from the definitions; shared with the Spark side is only the class that a signature file states."""

from __future__ import annotations

from strandline.operators.signature import DEFAULTS

# The published hash function's multipliers and addends, and the seed that sketches have.
C1, C2, N1, N2 = 9782798678568883157, 5545529020109919103, 1390208809, 944331445
F1, F2, SEED = 18397679294719823053, 14181476777654086739, 42
# The standard genetic code by amino acid.
AMINO = {
    "A": "GCT GCC GCA GCG", "C": "TGT TGC", "D": "GAT GAC", "E": "GAA GAG", "F": "TTT TTC", "G": "GGT GGC GGA GGG", "H": "CAT CAC", "I": "ATT ATC ATA",
    "K": "AAA AAG", "L": "TTA TTG CTT CTC CTA CTG", "M": "ATG", "N": "AAT AAC", "P": "CCT CCC CCA CCG", "Q": "CAA CAG", "R": "CGT CGC CGA CGG AGA AGG",
    "S": "TCT TCC TCA TCG AGT AGC", "T": "ACT ACC ACA ACG", "V": "GTT GTC GTA GTG", "W": "TGG", "Y": "TAT TAC", "*": "TAA TAG TGA",
}
CODONS = {codon: acid for acid, codons in AMINO.items() for codon in codons.split()}

CLASS = DEFAULTS["class"]
TABLES = (9973, 9967, 9949, 9941)
_U = 1 << 64


def _mul(a: str, b: str) -> str:
    return f"((({a}) * ({b})) % {_U}::UHUGEINT)"


def _add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_U}::UHUGEINT)"


def _rot(x: str, r: int) -> str:
    return f"((({x}) * {1 << r}::UHUGEINT) % {_U}::UHUGEINT + ({x}) // {1 << (64 - r)}::UHUGEINT)"


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _bytes(word: str, first: int, count: int) -> str:
    return "(" + " + ".join(f"coalesce(ascii(substr({word}, {first + i}, 1)), 0)::UHUGEINT * {256**i}::UHUGEINT" for i in range(count)) + ")"


def murmur(source: str, word: str, blocks: int) -> str:
    """A query with the columns of ``source`` and ``hash`` (UHUGEINT): ``blocks`` whole blocks, then up to 15 bytes."""
    q = f"SELECT *, {_u(SEED)} AS h1, {_u(SEED)} AS h2 FROM {source}"
    for b in range(blocks):
        k1 = _mul(_rot(_mul(_bytes(word, 16 * b + 1, 8), _u(C1)), 31), _u(C2))
        k2 = _mul(_rot(_mul(_bytes(word, 16 * b + 9, 8), _u(C2)), 33), _u(C1))
        q = f"SELECT * REPLACE ({_add(_mul(_add(_rot(f'xor(h1, {k1})', 27), 'h2'), _u(5)), _u(N1))} AS h1) FROM ({q})"
        q = f"SELECT * REPLACE ({_add(_mul(_add(_rot(f'xor(h2, {k2})', 31), 'h1'), _u(5)), _u(N2))} AS h2) FROM ({q})"
    at = 16 * blocks + 1
    q = f"SELECT *, {_bytes(word, at, 8)} AS k1, {_bytes(word, at + 8, 7)} AS k2 FROM ({q})"
    k1, k2 = _mul(_rot(_mul("k1", _u(C1)), 31), _u(C2)), _mul(_rot(_mul("k2", _u(C2)), 33), _u(C1))
    length = f"length({word})::UHUGEINT"
    q = f"SELECT * REPLACE (xor(xor(h1, {k1}), {length}) AS h1, xor(xor(h2, {k2}), {length}) AS h2) FROM ({q})"
    q = f"SELECT * REPLACE ({_add('h1', 'h2')} AS h1) FROM ({q})"
    q = f"SELECT * REPLACE ({_add('h2', 'h1')} AS h2) FROM ({q})"
    shifted = lambda x: f"xor({x}, ({x}) // {1 << 33}::UHUGEINT)"
    for factor in (F1, F2):
        q = f"SELECT * REPLACE ({_mul(shifted('h1'), _u(factor))} AS h1, {_mul(shifted('h2'), _u(factor))} AS h2) FROM ({q})"
    return f"SELECT * EXCLUDE (h1, h2, k1, k2), {_add(shifted('h1'), shifted('h2'))} AS hash FROM ({q})"


_PLAIN = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _shingles(name: str, table: str, columns: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (w, i), ('0x' || substr(md5(concat_ws(' ', w[i], w[i + 1], w[i + 2])), 1, 15))::BIGINT AS hk
      FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {columns}, {_PLAIN} AS w FROM {table})))"""


DOCS = _shingles("sh", "documents", "doc_id AS id, lang, source")
ITEMS = _shingles("bsh", "benchmark", "item_id AS id")


def _bottom(name: str, source: str, by: str, num: int) -> str:
    return f"""{name} AS (SELECT {by}, hk, n AS abund FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY hk) AS r
      FROM (SELECT {by}, hk, count(*) AS n FROM {source} GROUP BY {by}, hk)) WHERE r <= {num})"""


SKETCHES = f"{DOCS}, {_bottom('sk', 'sh', 'id', 100)}"
SCALED = f"{DOCS}, sk AS (SELECT DISTINCT id, hk FROM sh WHERE hk <= {1 << 56})"
BENCH = f"{ITEMS}, {_bottom('bk', 'bsh', 'id', 100)}"
GROUPS = f"""{DOCS}, named AS (SELECT concat_ws('-', lang, source) AS name, hk FROM sh),
  {_bottom('gk0', 'named', 'name', 200)},
  numbers AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT concat_ws('-', lang, source) AS name FROM documents)),
  gk AS (SELECT id, name, hk FROM gk0 JOIN numbers USING (name)),
  leaf AS (SELECT id, (SELECT count(DISTINCT name) - 1 FROM gk) + id AS pos, hk FROM gk),
  up AS (WITH RECURSIVE r(id, pos, hk, node) AS (SELECT id, pos, hk, (pos - 1) // 2 FROM leaf WHERE pos > 0
         UNION ALL SELECT id, pos, hk, (node - 1) // 2 FROM r WHERE node > 0) SELECT * FROM r)"""


def _pairs(left: str, right: str, threshold: float, cond: str = "true", num: int = 100) -> str:
    """CTEs ending in ``j``: (a, b, common, size, similarity) of pairs above a threshold, the union cut to num."""
    return f"""pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM {left} x JOIN {right} y USING (hk) WHERE {cond}),
      u AS (SELECT a, b, hk, max(l) AS l, max(r) AS r FROM (
          SELECT a, b, hk, 1 AS l, 0 AS r FROM pr JOIN {left} x ON x.id = a UNION ALL SELECT a, b, hk, 0, 1 FROM pr JOIN {right} y ON y.id = b) GROUP BY a, b, hk),
      cut AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hk) AS k FROM u),
      j AS (SELECT * FROM (SELECT a, b, sum(l * r)::BIGINT AS common, count(*) AS size, sum(l * r)::DOUBLE / count(*) AS similarity FROM cut WHERE k <= {num} GROUP BY a, b) WHERE similarity > {threshold})"""


_FOUND = f"""WITH {SKETCHES}, {BENCH}, {_pairs('sk', 'bk', 0.01)},
  info AS (SELECT id, concat_ws('-', any_value(lang), any_value(source)) AS name, md5('21' || string_agg((hk::HUGEINT + 9223372036854775808)::VARCHAR, '' ORDER BY hk)) AS md5
           FROM sk JOIN (SELECT doc_id AS id, lang, source FROM documents) USING (id) GROUP BY id),
  ranked AS (SELECT b AS query, a AS id, similarity, name, row_number() OVER (PARTITION BY b ORDER BY similarity DESC, name, md5, a) AS rank FROM j JOIN info ON info.id = a)"""


def _bins(source: str, columns: str) -> str:
    each = " UNION ALL ".join(f"SELECT {i} AS tbl, {n} AS m" for i, n in enumerate(TABLES))
    return f"bins AS (SELECT DISTINCT {columns}, tbl::BIGINT AS tbl, ((hk::HUGEINT + 9223372036854775808) % m)::BIGINT AS bin FROM {source}, ({each}))"


FILTERS = f"{DOCS}, nodes AS (SELECT DISTINCT concat_ws('-', lang, source) AS node, hk FROM sh), {_bins('nodes', 'node')}"
_OVERLAP = f"""WITH {FILTERS}, occ AS (SELECT node, count(*) AS n FROM bins GROUP BY node),
  o AS (SELECT x.node AS node_a, y.node AS node_b, count(*) AS shared FROM bins x JOIN bins y USING (tbl, bin) GROUP BY ALL),
  f AS (SELECT o.node_a, o.node_b, o.shared, p.n AS a, q.n AS b FROM o JOIN occ p ON p.node = o.node_a JOIN occ q ON q.node = o.node_b)"""
_MD5 = "md5('{k}' || string_agg((hk::HUGEINT + 9223372036854775808)::VARCHAR, '' ORDER BY hk))"
_TWO = f"""WITH {SKETCHES}, two AS (SELECT id::VARCHAR AS name, 21 AS ksize, hk FROM sk
  UNION ALL SELECT id::VARCHAR, 30, hk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hk) AS r FROM sk) WHERE r <= 10)"""
DNA = "SELECT doc_id AS id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents"
ROUGH = "SELECT doc_id AS id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTacgN') AS seq FROM documents"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TEXT_DNA = f"SELECT doc_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents"
ROUGH_TEXT = f"SELECT doc_id AS id, translate(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '{_LETTERS}0123456789', 'ACGTACGTACGTACGTACGTacgtacNNNNNNNNNN') AS seq FROM documents"
_RC = "reverse(translate({x}, 'ACGTacgt', 'TGCATGCA'))"


def _windows(source: str, k: int) -> str:
    return f"SELECT id, i - 1 AS i, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM ({source}))"


_K21 = f"(SELECT id, least(kmer, {_RC.format(x='kmer')}) AS kmer FROM ({_windows(DNA, 21)}))"
_CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in CODONS.items()) + "}"
_FRAMES = f"""strands AS (SELECT id, 0 AS s, upper(seq) AS seq FROM ({ROUGH}) UNION ALL SELECT id, 3, {_RC.format(x='upper(seq)')} FROM ({ROUGH})),
  frames AS (SELECT id, s + f AS frame, substr(seq, f + 1) AS seq FROM strands, (VALUES (0), (1), (2)) AS t(f)),
  proteins AS (SELECT id, frame::BIGINT AS frame, array_to_string(list_filter(list_transform(range(0, length(seq) // 3), lambda i: map_extract({_CODONS}, substr(seq, (3 * i + 1)::INT, 3))[1]), lambda x: x IS NOT NULL), '') AS protein FROM frames)"""

_WORDS = f"(SELECT DISTINCT unnest({_PLAIN}) AS word FROM documents)"
# One branch for each number of whole blocks: words of up to 127 bytes. A longer one would show as a missing row.
_LONG = " UNION ALL ".join(f"SELECT word, hash::VARCHAR AS hash FROM ({murmur(f'(SELECT word FROM {_WORDS} WHERE length(word) // 16 = {n})', 'word', n)})" for n in range(1, 8))

ORACLE = {
    "murmur_words": f"WITH m AS ({murmur(f'(SELECT DISTINCT unnest({_PLAIN}) AS word FROM documents)', 'word', 0)}) SELECT word, hash::VARCHAR AS hash FROM m WHERE length(word) <= 15",
    "murmur_long_words": _LONG,
    "murmur_kmers_21": f"WITH m AS ({murmur(_K21, 'kmer', 1)}) SELECT id, hash::VARCHAR AS hash, count(*) AS n FROM m GROUP BY ALL",
    "sketch_dna": f"WITH m AS (SELECT DISTINCT id, hash FROM ({murmur(_K21, 'kmer', 1)})) SELECT id, hash::VARCHAR AS hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hash) AS r FROM m) WHERE r <= 5",
    "kmers": _windows(ROUGH, 10),
    "kmers_canonical": f"SELECT least(kmer, {_RC.format(x='kmer')}) AS kmer, count(*) AS n FROM ({_windows(DNA, 8)}) GROUP BY 1",
    "revcomp": f"SELECT id, {_RC.format(x='seq')} AS rc FROM ({ROUGH})",
    "uppercase": "SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS upper_md5 FROM documents",
    "dna_filter": f"SELECT id, count(*) FILTER (WHERE regexp_full_match(kmer, '[ACGTacgt]*')) AS valid, count(*) FILTER (WHERE NOT regexp_full_match(kmer, '[ACGTacgt]*')) AS invalid FROM ({_windows(ROUGH, 10)}) GROUP BY id",
    "forced_kmers": f"SELECT id, count(*) FILTER (WHERE regexp_full_match(kmer, '[ACGTacgt]*')) AS n FROM ({_windows(ROUGH, 10)}) GROUP BY id",
    "translate_six_frame": f"WITH {_FRAMES} SELECT * FROM proteins",
    "protein_words": f"WITH {_FRAMES} SELECT id, count(*) AS words, count(DISTINCT substr(protein, i, 3)) AS distinct_words FROM (SELECT *, unnest(range(1, length(protein) - 1)) AS i FROM proteins) GROUP BY id",
    "text_frames": f"WITH {_FRAMES.replace(ROUGH, ROUGH_TEXT)} SELECT id, frame, length(protein) AS residues, md5(protein) AS protein_md5 FROM proteins",
    "text_kmers": f"""SELECT id, greatest(length(seq) - 20, 0) AS windows, list_sum(list_transform(string_split(upper(seq), 'N'), lambda x: greatest(length(x) - 20, 0)))::BIGINT AS valid,
      md5(array_to_string(list_transform(range(1, greatest(length(seq) - 20, 0) + 1), lambda i: substr(seq, i, 21)), ',')) AS kmers_md5 FROM ({ROUGH_TEXT})""",
    "text_sketch_jaccard": f"""WITH words AS (SELECT DISTINCT id, least(kmer, {_RC.format(x='kmer')}) AS kmer FROM ({_windows(TEXT_DNA, 21)})),
      each AS (SELECT DISTINCT kmer FROM words), m AS ({murmur('each', 'kmer', 1)}), sk AS (SELECT id, hash FROM words JOIN m USING (kmer) WHERE hash <= {1 << 58}::UHUGEINT),
      c AS (SELECT id, count(*) AS n FROM sk GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM sk x JOIN sk y USING (hash) WHERE x.id < y.id GROUP BY x.id, y.id),
      s AS (SELECT a, b, common, l.n + r.n - common AS size FROM p JOIN c l ON l.id = a JOIN c r ON r.id = b) SELECT *, common::DOUBLE / size AS similarity FROM s WHERE common::DOUBLE / size > 0.2""",
    "sketch_bottom_n": f"WITH {SKETCHES} SELECT id, hk FROM sk",
    "sketch_abundance": f"WITH {SKETCHES} SELECT id, hk, abund FROM sk",
    "sketch_scaled": f"WITH {SCALED} SELECT id, hk FROM sk",
    "downsample": f"WITH {SCALED} SELECT id, hk FROM sk WHERE hk <= {1 << 55}",
    "add_many_with_abund": "SELECT id, hk, abund FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hk) AS r FROM (SELECT o_custkey AS id, l_partkey AS hk, sum(l_quantity::BIGINT)::BIGINT AS abund FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 1 GROUP BY ALL)) WHERE r <= 20",
    "merge_sketches": f"WITH {SKETCHES} SELECT lang, hk, abund FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hk) AS r FROM (SELECT lang, hk, sum(abund)::BIGINT AS abund FROM sk JOIN documents ON doc_id = id GROUP BY lang, hk)) WHERE r <= 100",
    "merge_neighbours": f"WITH {SKETCHES}, ids AS (SELECT DISTINCT id FROM sk), p AS (SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON y.id = x.id + 1), m AS (SELECT a, hk, sum(abund)::BIGINT AS abund FROM p JOIN sk ON sk.id IN (a, b) GROUP BY a, hk) SELECT a, hk, abund FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hk) AS r FROM m) WHERE r <= 100",
    "add_from": f"WITH {DOCS}, {_bottom('t', 'sh', 'lang', 40)}, {_bottom('o', 'sh', 'lang', 80)} SELECT lang, hk, abund FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hk) AS r FROM (SELECT lang, hk, sum(abund)::BIGINT AS abund FROM (SELECT * FROM t UNION ALL SELECT lang, hk, 1 FROM o) GROUP BY lang, hk)) WHERE r <= 60",
    "import_counts": "SELECT event_type, user_id::VARCHAR AS hash, count(*) AS abund FROM events GROUP BY ALL",
    "getters": f"WITH {SKETCHES} SELECT id, 100::BIGINT AS num, 21::BIGINT AS ksize, false AS is_protein, 42::BIGINT AS seed, 0::BIGINT AS max_hash, true AS tracks, count(*) AS size, min(hk) AS first_min, arg_min(abund, hk) AS first_abund, CASE WHEN count(*) = 100 THEN max(hk) ELSE -1 END AS last_min FROM sk GROUP BY id",
    "count_common_pairs": f"WITH {SCALED}, c AS (SELECT id, count(*) AS n FROM sk GROUP BY id) SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(p.n) AS size_a, any_value(q.n) AS size_b FROM sk x JOIN sk y USING (hk) JOIN c p ON p.id = x.id JOIN c q ON q.id = y.id WHERE x.id < y.id GROUP BY x.id, y.id",
    "jaccard_pairs_scaled": f"WITH {SCALED}, c AS (SELECT id, count(*) AS n FROM sk GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM sk x JOIN sk y USING (hk) WHERE x.id < y.id GROUP BY x.id, y.id), s AS (SELECT a, b, common, m.n + o.n - common AS size FROM p JOIN c m ON m.id = a JOIN c o ON o.id = b) SELECT *, common::DOUBLE / size AS similarity FROM s WHERE common::DOUBLE / size > 0.05",
    "jaccard_pairs_bottom_n": f"WITH {SKETCHES}, {_pairs('sk', 'sk', 0.1, 'x.id < y.id')} SELECT * FROM j",
    "intersection_neighbours": f"""WITH {SKETCHES}, ids AS (SELECT DISTINCT id FROM sk), p AS (SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON y.id = x.id + 1),
      u AS (SELECT a, hk, count(*) AS n FROM p JOIN sk ON sk.id IN (a, b) GROUP BY a, hk), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hk) AS r FROM u)
      SELECT a, count(*) FILTER (WHERE n = 2 AND r <= 100) AS common, count(*) FILTER (WHERE r <= 100) AS size, count(*) FILTER (WHERE n = 2) AS shared, (count(*) FILTER (WHERE n = 2 AND r <= 100))::DOUBLE / count(*) FILTER (WHERE r <= 100) AS similarity FROM k GROUP BY a""",
    "compatibility": """WITH s AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 21 ELSE 31 END AS k, n_nationkey % 3 = 0 AS p, n_nationkey % 5 AS m, n_nationkey % 7 AS s FROM nation
        UNION ALL SELECT n_nationkey + 100, 21, false, 0, 42 FROM nation)
      SELECT x.id AS a, CASE WHEN x.k <> y.k THEN 'MismatchKSizes: different ksizes cannot be compared' WHEN x.p <> y.p THEN 'MismatchDNAProt: DNA/prot minhashes cannot be compared'
        WHEN x.m <> y.m THEN 'MismatchMaxHash: mismatch in max_hash; comparison fail' WHEN x.s <> y.s THEN 'MismatchSeed: mismatch in seed; comparison fail' ELSE '' END AS mismatch,
        x.k = y.k AND x.p = y.p AND x.m = y.m AND x.s = y.s AS equal FROM s x JOIN s y ON y.id = x.id + 1""",
    "containment_benchmark": f"WITH {DOCS}, {ITEMS}, x AS (SELECT DISTINCT id, hk FROM bsh), y AS (SELECT DISTINCT id, hk FROM sh), c AS (SELECT id, count(*) AS n FROM x GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM x JOIN y USING (hk) GROUP BY x.id, y.id) SELECT a, b, common, n AS size_a, common::DOUBLE / n AS containment FROM p JOIN c ON c.id = a WHERE common::DOUBLE / n > 0.2",
    "search_topk": f"{_FOUND} SELECT query, id, similarity, name, rank FROM ranked WHERE rank <= 3",
    "search_best_only": f"{_FOUND} SELECT query, id, similarity FROM ranked WHERE rank = 1",
    "search_report": f"{_FOUND} SELECT query, rank, printf('%6.1f%%       %-60s', similarity * 100, name) AS line FROM ranked",
    "search_containment": f"WITH {SKETCHES}, {BENCH}, c AS (SELECT id, count(*) AS n FROM bk GROUP BY id), p AS (SELECT y.id AS query, x.id AS id, count(*) AS common FROM bk x JOIN sk y USING (hk) GROUP BY ALL) SELECT query, p.id, common::DOUBLE / n AS similarity FROM p JOIN c ON c.id = p.id WHERE common::DOUBLE / n > 0.1",
    "search_databases": f"SELECT 'documents' AS db, * FROM (WITH {SKETCHES}, {BENCH}, {_pairs('sk', 'bk', 0.02)} SELECT b AS query, a AS id, similarity FROM j) UNION ALL SELECT 'benchmark', * FROM (WITH {BENCH}, {_pairs('bk', 'bk', 0.02)} SELECT b AS query, a AS id, similarity FROM j)",
    "linear_vs_tree": f"WITH {GROUPS}, {_pairs('gk', 'gk', 0.005, num=200)} SELECT b AS query, a AS id, 1::BIGINT AS linear, 1::BIGINT AS tree FROM j",
    "leaf_overlap": f"WITH {GROUPS} SELECT x.id, count(y.hk) AS common FROM gk x LEFT JOIN (SELECT hk FROM gk WHERE id = 0) y USING (hk) GROUP BY x.id",
    "bloom_build": f"WITH {FILTERS} SELECT node, tbl, (bin + 1 + 32767) // 32768 AS bucket, count(*) AS bits FROM bins GROUP BY ALL",
    "bloom_union": f"WITH {FILTERS} SELECT lang, count(*) AS occupied FROM (SELECT DISTINCT string_split(node, '-')[1] AS lang, tbl, bin FROM bins) GROUP BY lang",
    "bloom_occupied": f"WITH {FILTERS} SELECT node, count(*) AS occupied FROM bins GROUP BY node",
    "bloom_unique": f"WITH {DOCS}, {_bins('sh', 'id, hk')}, f AS (SELECT tbl, bin, min((id, hk)) AS first FROM bins GROUP BY ALL) SELECT 'all' AS node, count(DISTINCT first) AS unique_kmers FROM f",
    "bloom_membership": f"WITH {FILTERS}, {ITEMS}, {_bins('bsh', 'hk').replace('bins AS', 'asked AS')}, h AS (SELECT node, hk, count(*) AS n FROM bins JOIN asked USING (tbl, bin) GROUP BY ALL) SELECT node, count(*) AS found FROM h WHERE n = {len(TABLES)} GROUP BY node",
    "bloom_similarity": f"{_OVERLAP} SELECT node_a, node_b, shared, a + b - shared AS either, shared::DOUBLE / (a + b - shared) AS similarity FROM f",
    "bloom_containment": f"{_OVERLAP} SELECT node_a, node_b, shared, shared::DOUBLE / {sum(TABLES)} AS of_capacity, shared::DOUBLE / a AS of_bits FROM f",
    "oxli_roundtrip": f"WITH {FILTERS} SELECT node, tbl, count(*) AS bits, sum(bin)::BIGINT AS bin_sum FROM bins GROUP BY ALL",
    "signature_md5": f"WITH {SKETCHES} SELECT id, {_MD5.format(k=21)} AS md5 FROM sk GROUP BY id",
    "select_signatures": f"{_TWO} SELECT name, 1::BIGINT AS sketch_no, count(*) AS size, 'CC0' AS license, 0.4::DOUBLE AS version FROM two WHERE ksize = 30 GROUP BY name",
    "sig_roundtrip": f"{_TWO} SELECT name, ksize::BIGINT AS ksize, count(*) AS size, md5(ksize::VARCHAR || string_agg((hk::HUGEINT + 9223372036854775808)::VARCHAR, '' ORDER BY hk)) AS md5 FROM two GROUP BY name, ksize",
    "sig_files_roundtrip": f"{_TWO}, s AS (SELECT name, ksize::BIGINT AS ksize, count(*) AS size, md5(ksize::VARCHAR || string_agg((hk::HUGEINT + 9223372036854775808)::VARCHAR, '' ORDER BY hk)) AS md5 FROM two GROUP BY name, ksize) SELECT codec, s.* FROM s, (VALUES ('none'), ('gzip'), ('bzip2'), ('lzma')) AS t(codec)",
    "index_roundtrip": f"{_TWO} SELECT CASE WHEN ksize = 21 THEN 'dna' ELSE 'protein' END AS part, name, ksize::BIGINT AS ksize, count(*) AS size, md5(ksize::VARCHAR || string_agg((hk::HUGEINT + 9223372036854775808)::VARCHAR, '' ORDER BY hk)) AS md5 FROM two GROUP BY name, ksize",
    "signature_json": f"""{_TWO}, counted AS (SELECT name, ksize, (hk::HUGEINT + 9223372036854775808)::VARCHAR AS h, hk, abund FROM two JOIN (SELECT id::VARCHAR AS name, hk, abund FROM sk) USING (name, hk)),
      one AS (SELECT name, ksize, '{{"num":' || (CASE WHEN ksize = 21 THEN 100 ELSE 10 END) || ',"ksize":' || ksize || ',"seed":42,"max_hash":0,"mins":[' || string_agg(h, ',' ORDER BY hk) || '],"md5sum":"' || md5(ksize::VARCHAR || string_agg(h, '' ORDER BY hk)) || '",'
        || CASE WHEN ksize = 21 THEN '"abundances":[' || string_agg(abund::VARCHAR, ',' ORDER BY hk) || '],"molecule":"DNA"}}' ELSE '"molecule":"protein"}}' END AS j FROM counted GROUP BY name, ksize)
      SELECT '{{"class":"{CLASS}","email":"","hash_function":"0.murmur64","name":"' || name || '","license":"CC0","version":0.4,"signatures":[' || string_agg(j, ',' ORDER BY ksize) || ']}}' AS json FROM one GROUP BY name""",
    "signature_equality": f"WITH {DOCS} SELECT DISTINCT id::VARCHAR AS name, true AS same_first, false AS same_email FROM sh",
    "signature_accessors": f"WITH {SKETCHES} SELECT id::VARCHAR AS name, '' AS filename, 'CC0' AS license, count(*) AS first_size, 3::BIGINT AS pushed, 1::BIGINT AS set_to FROM sk GROUP BY id",
    "codec_sniff": "SELECT doc_id, c AS codec, c AS sniffed, true AS same FROM documents, (VALUES ('gzip'), ('bzip2'), ('lzma'), ('none')) AS t(c)",
    "tree_children": "SELECT o_orderkey::BIGINT AS pos, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 2 ELSE -1 END::BIGINT AS parent, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 10 ELSE -1 END::BIGINT AS parent_10, (2 * o_orderkey + 2)::BIGINT AS right, concat_ws(',', 3 * o_orderkey + 1, 3 * o_orderkey + 2, 3 * o_orderkey + 3) AS children_3 FROM orders",
    "tree_min_n_below": f"WITH {GROUPS}, s AS (SELECT node, id, count(*) AS n FROM up GROUP BY ALL) SELECT node AS pos, min(n) AS min_n_below FROM s GROUP BY node",
    "tree_file_filters": f"WITH {GROUPS}, {_bins('up', 'node')} SELECT node, count(*) AS occupied, 21::BIGINT AS ksize, '{','.join(map(str, TABLES))}' AS sizes FROM bins GROUP BY node",
    "tree_node_filters": f"WITH {GROUPS}, {_bins('up', 'node')} SELECT node, count(*) AS occupied FROM bins GROUP BY node",
    "stream_counts": "SELECT event_type, count(DISTINCT props) AS distinct_words, count(props)::BIGINT AS words FROM events GROUP BY event_type",
}
