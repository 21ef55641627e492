"""The registered query of each operator: its whole table, production parameters, and a digest of the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemass.llm import centroids, chat, decontaminate, htmltext, langid, licenses, merkle, mixing, packing, simhash, substring, tokencount, topk


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, n_shingles, n_found, containment."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, read back from the rendered text, of every conversation and of one that holds control strings."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    events = rows.withColumns({"seq": F.col("turn"), "kind": F.lit("message")})
    back = chat.read_back(chat.format_chats(events))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["masked"]), lambda t: t["text"]), "")
    digest = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("_whole"), loss.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    return digest.select(
        "conv_id", "n_turns", F.sha2("_whole", 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text: doc_id, n_bytes, n_tokens, over_limit."""
    counted = tokencount.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every text."""
    scanned = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required", "choices")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that an earlier document's 13-word windows cover, removed: doc_id, n_words, n_removed, kept_sha256."""
    done = substring.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept = langid.held_out(F.col("doc_id"))
    net = langid.train(docs.where(~F.coalesce(kept, F.lit(False))))
    told = langid.identify(docs.select("doc_id", "text"), net)
    return told.select("doc_id", F.coalesce(kept, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds around 40 centroids."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a row that may have been changed still gives the root."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    digest = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", _UPPER, _LOWER)
    leaves = docs.select("doc_id", "lang", digest(F.col("text")).alias("leaf"), F.when(changed, digest(lower)).alias("_now"))
    found = merkle.proofs(leaves).withColumn("folded_root", merkle.fold(F.coalesce("_now", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken."""
    return mixing.taken(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_format, op3_packing, op4_token_counts, op5_license_scan, op6_html_extract,
        op7_exact_topk, op8_substring_dedup, op9_language_id, op10_simhash, op11_centroid_clusters, op12_merkle_manifest, op13_source_mix)}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one after the other, in whole numbers."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::bigint"
    parts = [
        """v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c0 as (select row_number() over (order by sha256('2:' || vec_id) nulls last, e) - 1 c, e from v
  qualify row_number() over (order by sha256('2:' || vec_id) nulls last, e) <= {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select r, vec_id, e, min(struct_pack(d := d, c := c)) b from (select v.*, c.c, {square} d from v, c{n} c) group by all)")
        if n < rounds:
            floor_mean = "((s - ((s % n) + n) % n) // n)::bigint"
            parts.append(
                f"""m{n} as (select c, list({floor_mean} order by i) e from (select b.c c, i, sum(e[i])::hugeint s, count(*) n
  from a{n}, range(1, 65) t(i) group by all) group by c),
 c{n + 1} as materialized (select c, coalesce(m{n}.e, c{n}.e) e from c{n} left join m{n} using (c))"""
            )
    last = f"a{rounds}"
    return "with " + ",\n ".join(parts) + f"""
select vec_id, b.c::int "cluster", b.d distance, (sum(b.d) over (partition by b.c))::bigint cluster_inertia, (sum(b.d) over ())::bigint inertia,
 sha256(array_to_string(c.e, ',')) centroid_sha256 from {last} join c{rounds} c on b.c = c.c"""


def _merkle_sql(fanout: int = 8) -> str:
    """Nodes level by level by one recursion; a leaf's siblings and what a changed leaf gives by another."""
    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    digest = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(substr(doc_id::varchar, i, 1)) >> j) & 1)))"
    crc = f"list_reduce(list_prepend(4294967295::bigint, {bits}::bigint[]), lambda a, b: xor(a >> 1, case when xor(a, b) & 1 = 1 then 3988292384::bigint else 0::bigint end))"
    up = f"pos // {fanout}, (any_value(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' order by pos))"
    step = f"""f.pos // {fanout}, (f.n + {fanout - 1}) // {fanout}, sha256(string_agg(case when u.pos = f.pos then f.h else u.h end, '' order by u.pos)),
   f.proof || coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos <> f.pos), '')"""
    same = f"f.lvl = u.lvl and f.pos // {fanout} = u.pos // {fanout}"
    return f"""
with recursive r as (select row_number() over () rid, doc_id, lang, {digest("text")} leaf,
  case when xor({crc}, 4294967295::bigint) % 3 = 0 then {digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} end changed from documents),
 p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from r),
 up(lang, lvl, pos, n, h) as (select lang, 0, pos, n, leaf from p union all select lang, lvl + 1, {up} from up where n > 1 group by lang, lvl, pos // {fanout}),
 subs as (select lang, h subroot, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from up where n = 1),
 top(lvl, pos, n, h) as (select 0, pos, n, subroot from subs union all select lvl + 1, {up} from top where n > 1 group by lvl, pos // {fanout}),
 fold(rid, lang, lvl, pos, n, h, proof) as (select rid, lang, 0, pos, n, coalesce(changed, leaf), '' from p union all select f.rid, f.lang, f.lvl + 1, {step}
   from fold f join up u on f.lang is not distinct from u.lang and {same} where f.n > 1 group by f.rid, f.lang, f.lvl, f.pos, f.n, f.h, f.proof),
 high(rid, lvl, pos, n, h, proof) as (select f.rid, 0, s.pos, s.n, f.h, f.proof from fold f join subs s on f.lang is not distinct from s.lang where f.n = 1
   union all select f.rid, f.lvl + 1, {step} from high f join top u on {same} where f.n > 1 group by f.rid, f.lvl, f.pos, f.n, f.h, f.proof)
select doc_id, leaf, subroot, t.h root, sha256(proof) proof_sha256, high.h folded_root, high.h = t.h verified
from high join p using (rid) join subs s on p.lang is not distinct from s.lang, (select h from top where n = 1) t where high.n = 1"""


ORACLE_SQL = {
    "op1_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') w from documents),
 b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') w from benchmark),
 bs as (select distinct item_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
   else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from b where len(w) > 0),
 ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s from d where len(w) >= 5),
 n as (select item_id, count(*) n_shingles from bs group by 1)
select doc_id, item_id, n_shingles, count(*) n_found, count(*) / n_shingles containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n_shingles having count(*) >= 0.8 * n_shingles - 1e-9""",
    "op2_chat_format": r"""
with r as (select conv_id, turn, role, coalesce(text, '') t from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || t || chr(10), '' order by turn) whole,
  coalesce(string_agg(t, '' order by turn) filter (role = 'assistant'), '') loss,
  sum(8 + 8 + 7 + length(role) + length(t) + length(t) - length(replace(replace(replace(t, chr(92), ''), '<', ''), '[', ''))) formatted_chars
  from r group by conv_id)
select conv_id, n_turns, sha256(whole) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, formatted_chars::bigint formatted_chars from g""",
    "op7_exact_topk": r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint score
  from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as "rank", vec_id, score
from p qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
    "op8_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 win as (select doc_id, unnest(range(1, len(w) - 11)) i, w from d where len(w) >= 13),
 h as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from win),
 gone as (select doc_id, i from h join (select s, min(doc_id) m from h group by s) using (s) where m < doc_id),
 bad as (select distinct doc_id, unnest(range(i, i + 13)) p from gone),
 w as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
 k as (select doc_id, count(*) n, string_agg(word, ' ' order by p) t from w anti join bad using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (doc_id)""",
    "op11_centroid_clusters": _clusters_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op13_source_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  sha256('13:' || coalesce(doc_id::varchar, '-')) h from documents),
 g as (select source, sum(size)::bigint s, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w from d group by source),
 o as (select *, 1.5::double * sum(s) over () t, sum(w) over () all_w, coalesce(sum(2 * s) over earlier, 0)::double held, coalesce(sum(w) over earlier, 0) held_w
  from g window earlier as (order by 2 * s / w, source rows between unbounded preceding and 1 preceding)),
 l as (select (t - held) / (all_w - held_w) level from o where (t - held) / (all_w - held_w) * w <= 2 * s order by 2 * s / w, source limit 1),
 q as (select source, s, least((2 * s)::double, w * level) target from g, l),
 p as (select d.*, s, target, round(target)::bigint n, (sum(size) over (partition by d.source order by h, size, doc_id) - size)::bigint a
  from d join q on d.source is not distinct from q.source)
select doc_id, size, s source_size, target, (greatest(0, least(a + size, n) - a) + greatest(0, least(a + s + size, n) - a - s))::bigint taken from p""",
}
