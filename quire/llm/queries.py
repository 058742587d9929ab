"""The subpackage's operators bound to the driver's tables, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import attribution, bpe, conversation_trie, decontaminate, html_text, importance, license_scan, lm, minhash, mixing, secret_scan, spelling, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@register("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leaked into documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_source_mix")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


COMPONENT = """r as (select i a, i b from ids union select r.a, l.b from r join l on r.b = l.a)"""
SHINGLE_SQL = rf"""with recursive
 w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') a from documents),
 s as (select doc_id, case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')] else list_distinct([array_to_string(a[i:i+4], ' ') for i in range(1, len(a) - 3)]) end g from w),
 u as (select doc_id, len(g) n, unnest(g) x from s),
 p as (select a.doc_id i, b.doc_id j, any_value(a.n) n, any_value(b.n) m, count(*) c from u a join u b using (x) where a.doc_id < b.doc_id group by 1, 2),
 e as (select i, j from p where 100 * c >= 75 * (n + m - c)),
 l as (select i a, j b from e union all select j, i from e), ids as (select doc_id i from documents),
 {COMPONENT}, c as (select a, min(b) m from r group by a)
 select doc_id, len(g) n_shingles, m component_id, doc_id = m kept from s join c on c.a = s.doc_id"""
VECTOR_SQL = f"""with recursive
 v as (select vec_id, cast(embedding as double[]) e from embeddings),
 l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95), ids as (select vec_id i from v),
 {COMPONENT}, c as (select a, min(b) m from r group by a), n as (select a, count(*) k from l group by a)
 select vec_id, coalesce(k, 0) n_links, m component_id, vec_id = m kept from v join c on c.a = vec_id left join n on n.a = vec_id"""

# CRC-32 by table: entry i is i after eight steps of the reflected polynomial.
CRC_TABLE = """tab as (select list(v order by i) tab from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) v from range(256) r(i)))"""


def crc32_sql(digits: str) -> str:
    """CRC-32 of the bytes that the SQL expression ``digits`` spells in hexadecimal; needs ``CRC_TABLE``."""
    codes = f"[('0x' || substr({digits}, 2 * i + 1, 2))::bigint for i in range(length({digits}) // 2)]"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295)"


SPELLING_SQL = rf"""with recursive {CRC_TABLE},
 r as (select coalesce(doc_id::varchar, '') i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) w from documents),
 g as (select w, hex(i || ':' || w) x, count(*) n from r where length(w) > 5 group by i, w),
 h as (select w, n, {crc32_sql('x')} h from g, tab),
 c as (select case when h % 199 = 0 then w[1:h % length(w)] || w[h % length(w) + 2:] else w end word, sum(n)::bigint n from h group by 1 having length(word) > 5 and sum(n) >= 5),
 d as (select word, n, unnest(range(length(word))) i, word[1:i] || word[i + 2:] v from c),
 e as (select a.word a, b.word b from d a join d b on a.i = b.i and a.v = b.v and length(a.word) = length(b.word) and a.word <> b.word union select d.word, c.word from d join c on c.word = d.v union select c.word, d.word from d join c on c.word = d.v),
 f as (select a, count(*) n_near, first(b order by n desc, b) b, max(n) m from e join c on c.word = b group by a),
 z as (select word, n, coalesce(n_near, 0) n_near, case when m >= 5 * n then b end form, case when m >= 5 * n then m end form_n from c left join f on a = word),
 y as (select word, word f, 0 k from z union all select y.word, z.form, k + 1 from y join z on z.word = f where form is not null)
 select z.word, form, root, n, n_near, form_n from z join (select word, max_by(f, k) root from y group by word) q on q.word = z.word"""
TRIE_SQL = rf"""with {CRC_TABLE},
 o as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) o from conversations where conv_id is not null group by 1),
 h as (select conv_id, o, {crc32_sql("hex(conv_id::varchar)")} % 9 h from o, tab),
 b as (select h.conv_id, coalesce(g.o, [])[1:h] || h.o[h + 1:] s from h left join o g on g.conv_id = h.conv_id - h.conv_id % 5),
 m as (select conv_id, len(s) n, unnest(range(len(s) + 1)) d, s[1:d] p, s[1:d - 1] q from b),
 x as (select p, d, any_value(q) q, min(conv_id) c, count(*) n, list(conv_id order by conv_id) filter (where n = d) e from m group by 1, 2),
 k as (select q, d - 1 d, count(*) k from x where d > 0 group by 1, 2),
 v as (select x.*, coalesce(k, 0) k, case when x.d > 0 then (n - 1) * strlen(x.p[x.d].t) else 0 end s from x left join k on k.q = x.p and k.d = x.d),
 u as (select distinct a.p, a.d, w.p p2, w.d d2, v.k, v.s from m a join m w on a.conv_id = w.conv_id and w.d >= a.d join v on v.p = w.p and v.d = w.d),
 t as (select p, d, count(*) filter (where k = 0) leaves, sum(s) saved from u group by 1, 2)
 select v.c conv_id, v.d depth, y.c parent_conv_id, v.n n_convs, v.k n_children, leaves n_leaves, saved saved_tokens, sha256(coalesce(array_to_string(v.e, ','), '')) ends_sha256
 from v join t on t.p = v.p and t.d = v.d left join v y on y.p = v.q and y.d = v.d - 1"""


@register("op3_minhash_dedup", SHINGLE_SQL)
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_embedding_dedup", VECTOR_SQL)
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register("op6_lm_scores")
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the base and the backoff model."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@register("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per line of every document, boundary-crossing tokens counted where they start."""
    return attribution.section_counts(table(spark, sf_dir, "documents"))


@register("op9_importance_resampling")
def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether the draw keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "labels")).drop("text")


@register("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as counts and spans."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document, and what they decode to, as digests."""
    return bpe.encoding_digest(table(spark, sf_dir, "documents"))


@register("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, the form each is a variant of, and how many words are one edit away."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))
