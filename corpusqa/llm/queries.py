"""The operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.shingle_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(2, len(w) - 3))]) END AS s FROM words),
tokens AS (SELECT doc_id, hash(t) AS t FROM (SELECT doc_id, unnest(s) AS t FROM sets)),
classes AS (
  SELECT min(doc_id) AS rep, list(doc_id) AS members, any_value(len(s)) AS n
  FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
rare AS (
  SELECT k.doc_id, k.t, c.n FROM tokens k JOIN classes c ON c.rep = k.doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m
  FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 75 * (n + m - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT rep AS node, rep AS low FROM classes
  UNION
  SELECT b.y, r.low FROM reach r JOIN edges b ON b.x = r.node WHERE r.low < b.y),
roots AS (SELECT node, min(low) AS low FROM reach GROUP BY 1),
member AS (SELECT unnest(members) AS doc_id, rep FROM classes)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.low, s.doc_id) AS component_id
FROM sets s LEFT JOIN member m ON m.doc_id = s.doc_id LEFT JOIN roots r ON r.node = m.rep
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op2_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM twice)),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, (SELECT unnest(range(0, 35)) AS k)),
gone AS (SELECT doc_id, list(i) AS g FROM covered GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
  FROM words d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


@query
def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusqa.llm.bitpack import token_files
    from corpusqa.llm.encoding import read_vocabulary

    content = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files(_table(spark, sf_dir, "documents"), content, end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusqa.llm.encoding import read_vocabulary
    from corpusqa.llm.merge_replay import decode_ids, encode_texts

    ranks = read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = encode_texts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode_ids(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusqa.llm.encoding import read_vocabulary
    from corpusqa.llm.slack_packing import pack_sequences

    return pack_sequences(_table(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


@query
def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.block_labeller import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.ppm_language import identify

    return identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.grid_order_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


SQL["op5_grid_order_join"] = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
valid AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS low FROM vectors
  UNION
  SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node WHERE r.low < l.y),
roots AS (SELECT node, min(low) AS low FROM reach GROUP BY 1),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, r.low AS component_id, v.vec_id = r.low AS kept
FROM vectors v JOIN roots r ON r.node = v.vec_id LEFT JOIN counts c ON c.x = v.vec_id
"""


@query
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.learned_partitions import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.perspectives import rotate_perspectives

    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


SQL["op9_perspective_rotation"] = r"""
WITH messages AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
parties AS (SELECT DISTINCT conv_id, role AS perspective FROM messages WHERE role IS NOT NULL AND role <> 'system'),
views AS (
  SELECT m.*, p.perspective, coalesce(m.role = p.perspective, false) AS trained,
    CASE WHEN m.role = p.perspective THEN '<|assistant|>' || chr(10) WHEN m.role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || coalesce(m.role, 'unknown') || '|>' || chr(10) END AS head
  FROM messages m JOIN parties p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, length(head) + length(text) + length('<|end|>') + 1 AS size FROM views),
placed AS (
  SELECT *, row_number() OVER w AS position, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, perspective, position, turn, CASE WHEN trained THEN 'assistant' ELSE coalesce(role, 'unknown') END AS speaker, trained,
  head || text || '<|end|>' || chr(10) AS segment, CAST(start AS BIGINT) AS start,
  CASE WHEN trained THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN trained THEN CAST(start + size AS BIGINT) END AS mask_end
FROM placed
"""


@query
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SQL["op13_benchmark_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS gram
  FROM (SELECT item_id, unnest([w[i:i + 9] FOR i IN range(1, greatest(2, len(w) - 8))]) AS g FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT r, p.n, i, item_id FROM places p JOIN grams g ON p.gram = g.gram AND p.n = g.n),
counts AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS i FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN counts USING (r) LEFT JOIN listed USING (r)
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def _sql_crc32(data: str) -> str:
    """CRC-32 of a list of bytes in SQL, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)

    def nibble(c: str) -> str:
        return f"xor({c} >> 4, ({table})[({c} & 15) + 1])"

    fold = nibble(nibble("xor(c, b)"))
    return f"xor(list_reduce({data}, lambda c, b: {fold}, CAST(4294967295 AS BIGINT)), 4294967295)"


_DECIMAL = "list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))"

SQL["op11_prefix_trie"] = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_sql_crc32(_DECIMAL)} % 6 AS h, own
  FROM (SELECT conv_id, count(*) AS own FROM turns GROUP BY 1)),
sized AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT s.conv_id, pos AS depth, role, text FROM sized s JOIN turns t ON t.conv_id = s.base AND pos <= h
  UNION ALL SELECT s.conv_id, taken + pos - h, role, text FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND pos > h),
listed AS (
  SELECT s.conv_id, coalesce(l, []) AS l
  FROM sized s LEFT JOIN (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY depth) AS l FROM rebuilt GROUP BY 1) USING (conv_id)),
prefixes AS (
  SELECT conv_id, d, len(l) = d AS is_end, sha256(array_to_string(l[1:d], '')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(l[1:d - 1], '')) END AS parent
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM listed)),
members AS (
  SELECT p.*, coalesce(length(r.text), 0) AS chars FROM prefixes p LEFT JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.d),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM members GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.node),
sums AS (
  SELECT m.node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * f.chars) AS saved
  FROM full_nodes f JOIN members m ON m.conv_id = f.conv_id AND m.d <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.node = f.node LEFT JOIN nodes p ON p.node = f.parent
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusqa.llm.spelling_variants import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


# letters up to U+00FF are one or two bytes
_UTF8 = """flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(s[i]) < 128 THEN [CAST(unicode(s[i]) AS BIGINT)]
    ELSE [CAST(192 + (unicode(s[i]) >> 6) AS BIGINT), CAST(128 + (unicode(s[i]) & 63) AS BIGINT)] END))"""

SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
hashed AS (SELECT low, times, {_sql_crc32(_UTF8)} AS h FROM (SELECT low, d || ':' || low AS s, count(*) AS times FROM runs GROUP BY ALL)),
results AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2) ELSE low END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word AS a, h.n AS a_n, w.word AS b, w.n AS b_n FROM holes h JOIN words w ON w.word = h.part),
near AS (
  SELECT a AS word, a_n AS n, b AS near, b_n AS near_n FROM shorter
  UNION ALL SELECT b, b_n, a, a_n FROM shorter
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN holes b ON a.part = b.part AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 2 * w.n THEN top[2] END AS form, CASE WHEN -top[1] >= 2 * w.n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
