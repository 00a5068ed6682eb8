"""Registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.llm import (
    byte_bpe, conversations, decontaminate, licenses, line_dedup, ngram_join, order_minhash, quality, quality_rules, suffix_dedup, token_files, toxicity, whitening,
)
from scriptorium.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark, sf_dir):
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op3_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


def op6_license_scan(spark, sf_dir):
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), words=line_dedup.PASSAGE_WORDS)
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_order_minhash(spark, sf_dir):
    out = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    own, edited = F.col("signature"), F.col("edited_signature")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), order_minhash.text_of(own).alias("fingerprint"), order_minhash.text_of(edited).alias("edited_fingerprint"),
        order_minhash.likeness(own, edited).alias("near_edited"), order_minhash.likeness(own, F.col("next_signature")).alias("near_next"),
    )


def op9_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tie")


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(ids, path, public_tokenizers.PATTERN))


def op11_quality_rules(spark, sf_dir):
    out = quality_rules.ledger(table(spark, sf_dir, "documents"))
    out = quality_rules.apply_policy(quality_rules.apply_policy(out, quality_rules.PROSE), quality_rules.BASE, name="passed_base")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("passed_base")).alias("base_failed"), "kept")


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), top=4).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_token_files, op3_toxicity, op4_decontamination, op5_suffix_dedup, op6_license_scan, op7_line_dedup, op8_order_minhash, op9_quality, op10_byte_bpe, op11_quality_rules, op12_whitening, op13_conversation_repair)}

ORACLES = {
    "op6_license_scan": licenses.oracle(),
    "op11_quality_rules": quality_rules.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE + """
select d.doc_id, coalesce(r.n, 0) as n_lines, coalesce(g.n, 0) as n_removed_lines, sha256(coalesce(kept.text, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n from r group by all) r using (doc_id)
left join (select doc_id, count(*) as n from g group by all) g using (doc_id) left join kept using (doc_id)""",
    "op4_decontamination": r"""
with i as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark where text is not null
), n as (select item, w, least(13, len(w)) as n from i where len(w) > 0),
u as (select item, w, n, unnest(range(1, len(w) - n + 2)) as p from n),
v as (select n, array_to_string(w[p:p + n - 1], ' ') as win, list(distinct item) as items from u group by all),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
q as (select doc_id, w, l.n, unnest(range(1, greatest(len(w) - l.n + 2, 1))) as p from d, (select distinct n from v) l),
h as (select doc_id, q.n, p, items from (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win from q) q join v on v.win = q.win and v.n = q.n),
c as (select doc_id, count(distinct at_word) as n_hit from (select doc_id, unnest(range(p, p + n)) as at_word from h) group by all),
k as (select doc_id, list_sort(list(distinct item)) as ids from (select doc_id, unnest(items) as item from h) group by all)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, cast(coalesce(len(k.ids), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(k.ids, ','), '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join c using (doc_id) left join k using (doc_id)""",
}
