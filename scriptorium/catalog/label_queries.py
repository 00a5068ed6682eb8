"""Label store L1-L4, streams T1-T2, freezing and gates E15-E22."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.catalog.aggregate_queries import labelled_records
from scriptorium.catalog.join_queries import valid_saves
from scriptorium.catalog.registry import query
from scriptorium.operators import fingerprints as P
from scriptorium.plans import freezing as Z
from scriptorium.plans import labels as L
from scriptorium.plans.sessions import SessionLedger
from scriptorium.session import checkpoint_dir
from scriptorium.sources.snapshots import SnapshotStore
from scriptorium.streaming import labels as ST
from scriptorium.streaming import live as ST2

ORDER = ["ts", "event_id"]
_CURRENT = "select sample_id, event_id, evidence_type, case when is_empty then 'verified_empty' else 'annotated' end answer_status, cast(case when is_empty then 0 else 1 end as int) boxes from fx_current"


def new_root(fx, name):
    return f"{checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def current(fx):
    return L.current_labels(valid_saves(fx), ORDER)


@query("l1_current_labels", _CURRENT)
def _(fx):
    return current(fx).select("sample_id", "event_id", "evidence_type", "answer_status", F.size("boxes").alias("boxes"))


@query("l1_rejected_saves", "select event_id, 'positive_boxes' reject_reason from fx_saves where not is_empty and width<=0")
def _(fx):
    checked = L.validated_saves(fx.saves(), fx.label_samples())
    return checked.where("reject_reason is not null").select("event_id", "reject_reason")


@query("l2_version_history", """
    with c as (select sample_id, event_id, sha256(record) fp, lag(sha256(record)) over (partition by sample_id order by ts, event_id) prev from fx_records)
    select sample_id, event_id, fp fingerprint, prev previous_fingerprint from c where prev is null or prev<>fp""")
def _(fx):
    history = L.version_history(valid_saves(fx), "ts", "event_id", F.date_trunc("day", "ts"))
    return history.select("sample_id", "event_id", "fingerprint", "previous_fingerprint")


@query("l3_strict_geometry", """
    select event_id, cast(case event_id%8 when 0 then 1 when 3 then 0 when 5 then 1 end as int) boxes from fx_saves""")
def _(fx):
    # Event id mod 8: integer box, text coordinate, floating coordinate, empty list, spaced digits, spaced tokens, repeated field, beyond 32 bits.
    def rectangle(x):
        return F.concat(F.lit('[{"bbox": {"x": '), x, F.lit(', "y": 3, "width": 10, "height": 20}}]'))

    x = F.col("boxes")[0]["x"]
    number = F.coalesce(x, F.lit(7)).cast("string")
    kind = F.col("event_id") % 8
    raw = (
        F.when(kind == 0, rectangle(number)).when(kind == 1, rectangle(F.concat(F.lit('"'), number, F.lit('"'))))
        .when(kind == 2, rectangle(F.concat(number, F.lit(".5")))).when(kind == 3, F.lit("[]"))
        .when(kind == 4, rectangle(F.concat(number, F.lit(" 2")))).when(kind == 5, rectangle(F.concat(F.lit("  "), number, F.lit("\n"))))
        .when(kind == 6, rectangle(F.concat(number, F.lit(', "x": 1')))).otherwise(rectangle(F.lit("99999999999")))
    )
    return fx.saves().withColumn("boxes", F.when(F.size("boxes") > 0, F.col("boxes"))).select(
        "event_id", L.strict_boxes(raw).alias("b")
    ).select("event_id", F.when(F.col("b").isNotNull(), F.size("b")).alias("boxes"))


_APPROVALS = """
    ap as (select 's'||(event_id%3) session_id, sample_id, event_id, sha256(record) fp, row_number() over (partition by event_id%3, sample_id order by ts desc, event_id desc) rn from fx_records)"""


def ledger(fx):
    return L.with_record(valid_saves(fx)).select(
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("session_id"), "sample_id", "event_id", "ts", F.col("fingerprint").alias("approved_fingerprint")
    )


@query("l4_approvals", f"with {_APPROVALS} select session_id, sample_id, event_id, fp approved_fingerprint from ap where rn=1")
def _(fx):
    return L.approvals(ledger(fx), ORDER).drop("ts")


@query("l4_session", f"""
    with s as (select distinct concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events),
    o as (select sample_id, sha256(record) fp, row_number() over (partition by sample_id order by ts desc, event_id desc) rn from fx_records where ts < timestamp '2024-01-16'),
    c as (select r.sample_id, sha256(record) fp, user_id from fx_records r join fx_current f on r.event_id=f.event_id join (select distinct user_id, concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events) u on u.sample_id=r.sample_id),
    a as (select coalesce(n.sample_id, o.sample_id) sample_id, coalesce(n.fp, o.fp) fp from (select * from o where rn=1) o full join (select * from c where user_id%2=0) n on o.sample_id=n.sample_id),
    start as (select '{{"annotations":['||string_agg(record,',' order by sample_id)||'],"schema_version":"1.0"}}' doc from (select sample_id, record, row_number() over (partition by sample_id order by ts desc, event_id desc) rn from fx_records where ts < timestamp '2024-01-16') where rn=1)
    select s.sample_id, case when a.fp is null then 'missing' when a.fp=c.fp then 'valid' else 'changed' end status, sha256(start.doc) started_from
    from s left join a using (sample_id) left join c using (sample_id), start""")
def _(fx):
    books = SessionLedger(fx.spark, new_root(fx, "sessions"))
    early = L.current_labels(valid_saves(fx).where(F.col("ts") < F.lit(_MIDDLE).cast("timestamp")), ORDER)
    session = books.open(early)["session_id"]
    books.approve(session, 0, early.withColumn("approved_at", F.lit("2024-02-01").cast("timestamp")))
    # Opened again after more saves: the session and its start stay. Half of the samples are approved once more.
    now = current(fx)
    resumed = books.open(now, session)
    for _ in range(2):
        books.approve(session, 1, now.where(F.substring("sample_id", 8, 6).cast("int") % 2 == 0).withColumn("approved_at", F.lit("2024-02-02").cast("timestamp")))
    return books.status(session, fx.label_samples(), now).withColumn("started_from", F.lit(resumed["started_from"]))


# Streams ------------------------------------------------------------------------------------------


def write_saves(fx):
    """Every save as JSON in six files; returns the folder above them."""
    root = new_root(fx, "stream")
    box = F.col("boxes")[0]
    fields = [F.concat(F.lit(f'"{n}":'), box[n].cast("string")) for n in ("x", "y", "width", "height")]
    text = F.when(F.size("boxes") == 0, "[]").otherwise(F.concat(F.lit('[{"bbox":{'), F.concat_ws(",", *fields), F.lit("}}]")))
    saves = fx.saves().withColumn("boxes", F.when(F.size("boxes") > 0, F.col("boxes")).otherwise(F.array().cast(fx.saves().schema["boxes"].dataType)))
    saves.withColumn("answer_regions", text).drop("boxes").repartition(6, "event_id").write.json(f"{root}/saves")
    return root


def run_live(fx):
    """Run the live stream over all saves in two batches, return its folder."""
    root = write_saves(fx)
    ST2.start_live_labels(fx.spark, f"{root}/saves", fx.label_samples(), root=f"{root}/live", checkpoint=f"{root}/checkpoint", files_per_batch=3, available_now=True).awaitTermination()
    return f"{root}/live"


@query("t1_label_stream", _CURRENT)
def _(fx):
    root = write_saves(fx)
    ST.start_label_stream(
        fx.spark, f"{root}/saves", fx.label_samples(), log=f"{root}/log", quarantine=f"{root}/quarantine", checkpoint=f"{root}/checkpoint", files_per_batch=3, available_now=True,
    ).awaitTermination()
    return ST.read_current(fx.spark, f"{root}/log").select("sample_id", "event_id", "evidence_type", "answer_status", F.size("boxes").alias("boxes"))


@query("t1_live_labels", _CURRENT)
def _(fx):
    return ST2.live_labels(fx.spark, run_live(fx)).select("sample_id", "event_id", "evidence_type", "answer_status", F.size("boxes").alias("boxes"))


@query("t2_live_progress", """
    with s as (select distinct concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events)
    select count(c.evidence_type) completed, count(*) total, count(c.evidence_type)=count(*) ready, count(*) filter (where evidence_type='printed') n_printed, count(*) filter (where evidence_type='student_candidate') n_student_candidate,
      count(*) filter (where evidence_type='teacher_candidate') n_teacher_candidate, count(*) filter (where evidence_type='unknown') n_unknown from s left join fx_current c using (sample_id)""")
def _(fx):
    return ST2.live_progress(fx.spark, run_live(fx), fx.label_samples().count())


# Freezing and gates ---------------------------------------------------------------------------------

_DS = "'ds'||(cast(substr(sample_id,8) as int)%10)"
_FROZEN = f"""
    d as (select {_DS} dataset_id, r.* from fx_records r where event_id in (select event_id from fx_current)),
    f as (select dataset_id, sha256('{{"annotations":['||string_agg(record,',' order by sample_id)||'],"schema_version":"1.0"}}') fingerprint, count(*) annotation_count,
      count(*) filter (where not is_empty) human_answer_box_count, count(*) filter (where is_empty) verified_empty_count from d group by 1)"""


@query("e15_freeze_labels", f"with {_FROZEN} select * from f")
def _(fx):
    _, prov = L.freeze_labels(labelled_records(fx).drop("record", "fingerprint"), ["dataset_id"])
    return prov.select("dataset_id", "fingerprint", "annotation_count", "human_answer_box_count", "verified_empty_count")


def frozen_set(fx, store, until=None, parents=None):
    """Freezes the labels as they were at a moment; the manifest lists the samples labelled by then."""
    saves = valid_saves(fx) if until is None else valid_saves(fx).where(F.col("ts") < F.lit(until).cast("timestamp"))
    ds = F.concat(F.lit("ds"), (F.substring("sample_id", 8, 6).cast("int") % 10).cast("string")).alias("dataset_id")
    labels = L.current_labels(saves, ORDER).select(ds, "*")
    samples = fx.label_samples().join(labels.select("sample_id"), "sample_id", "left_semi").select(ds, "*")
    return Z.freeze_label_set(store, samples, labels, ["dataset_id"], parents=parents)


@query("e15_verify_frozen", f"with {_FROZEN} select distinct dataset_id from d where evidence_type='unknown' and sample_id in (select min(sample_id) from d group by dataset_id)")
def _(fx):
    from pyspark.sql import Window

    store = SnapshotStore(fx.spark, new_root(fx, "frozen"))
    record = frozen_set(fx, store)
    # Tamper with the stored file: the first label of every dataset, where it is an unknown one.
    rows = store.load(record["fingerprint"], "labels")
    first = F.col("sample_id") == F.min("sample_id").over(Window.partitionBy("dataset_id"))
    kind = F.when(F.col("_first") & (F.col("evidence_type") == "unknown"), "printed").otherwise(F.col("evidence_type"))
    changed = rows.withColumn("_first", first).withColumn("evidence_type", kind).drop("_first").checkpoint()
    changed.write.mode("overwrite").parquet(f"{store.root}/{record['data']}/labels")
    return Z.verify_label_set(store, record["fingerprint"], ["dataset_id"]).select("dataset_id").distinct()


_MIDDLE = "2024-01-16"


@query("e15_snapshot_versions", f"""
    with v as (select 'first' as version, * from fx_records where ts < timestamp '{_MIDDLE}' union all select 'second', * from fx_records),
    l as (select *, row_number() over (partition by version, sample_id order by ts desc, event_id desc) rn from v),
    d as (select version, {_DS} dataset_id, record, sample_id, is_empty from l where rn=1)
    select version, case version when 'second' then 'first' end parent, dataset_id, sha256('{{"annotations":['||string_agg(record,',' order by sample_id)||'],"schema_version":"1.0"}}') fingerprint, count(*) annotation_count,
      count(*) filter (where is_empty) verified_empty_count from d group by version, dataset_id""")
def _(fx):
    store = SnapshotStore(fx.spark, new_root(fx, "versions"))
    first = frozen_set(fx, store, _MIDDLE)
    frozen_set(fx, store, parents={"previous": first["fingerprint"]})
    names = dict(zip([r["fingerprint"] for r in store.history()], ("first", "second"), strict=True))
    out = None
    for record in store.history():
        rows = store.load(record["fingerprint"], "provenance").select(
            F.lit(names[record["fingerprint"]]).alias("version"), F.lit(names.get(record["parents"].get("previous"))).cast("string").alias("parent"),
            "dataset_id", "fingerprint", "annotation_count", "verified_empty_count",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("e16_validate_labels", """
    with s as (select distinct user_id, concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events)
    select sample_id, 'unexpected' problem from fx_current where sample_id not in (select sample_id from s where user_id%9<>0)
    union all select sample_id, 'missing' from s where user_id%9<>0 and sample_id not in (select sample_id from fx_current)
    union all select c.sample_id, 'box_outside_crop' from fx_current c join s using (sample_id) where user_id%9<>0 and not is_empty and (x+width>200 or y+20>600)
    union all select sample_id, 'image_missing' from s where user_id%9<>0 and user_id%5=0""")
def _(fx):
    user = F.substring("sample_id", 8, 6).cast("int")
    samples = fx.label_samples().where(user % 9 != 0).withColumn("crop_width", F.lit(200)).withColumn("crop_height", F.lit(600))
    return L.validate_labels(samples, current(fx), samples.where(user % 5 != 0))


@query("e17_refused_ground_truth", """
    with t as (select conv_id, turn, 'c'||conv_id||'_'||turn sample_id, case when turn%3=0 then case conv_id%4 when 0 then 'None' when 1 then '  ' when 2 then 'EMPTY' else text end when turn%3=1 and conv_id%7=0 then ' ' else text end entered, turn%3=0 is_empty from conversations)
    select sample_id, case when is_empty then 'unexpected_text_in_verified_empty' else 'pending_blank_transcription' end outcome from t
    where case when is_empty then length(trim(entered))>0 and lower(trim(entered)) not in ('empty','none','no student-answer text','no student answer text') else length(trim(entered))=0 end
    union all select sample_id, 'blank_note' from t where conv_id%5=0 and turn%2=0""")
def _(fx):
    c = fx.table("conversations").withColumn("sample_id", F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")))
    entered = (
        F.when(F.col("turn") % 3 == 0, F.when(F.col("conv_id") % 4 == 0, "None").when(F.col("conv_id") % 4 == 1, "  ").when(F.col("conv_id") % 4 == 2, "EMPTY").otherwise(F.col("text")))
        .when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 7 == 0), " ").otherwise(F.col("text"))
    )
    frozen, problems = L.freeze_ground_truth(
        c.select("sample_id", F.lit("").alias("notes")), c.select("sample_id", entered.alias("entered_text")), c.where("turn % 3 = 0").select("sample_id"),
        c.where("turn % 2 = 0").select("sample_id", F.when(F.col("conv_id") % 5 == 0, "\t").otherwise(F.col("role")).alias("note")),
    )
    # All or nothing: the bad samples leave no frozen row, so these would show up as frozen.
    return problems.select("sample_id", F.col("rule").alias("outcome")).unionByName(frozen.select("sample_id", F.lit("frozen").alias("outcome")))


_TRUTH = """
    t as (select conv_id, turn, 'c'||conv_id||'_'||lpad(cast(turn as varchar),6,'0') sample_id, role, turn%3=0 or length(trim(text))=0 is_empty, text from conversations),
    g as (select sample_id, 'p'||(conv_id%20) dataset_id, case when is_empty then 'verified_empty' else 'verified' end st, case when is_empty then '' else text end body, case when turn%2=0 then 'seen'||chr(10)||role else 'seen' end notes from t)"""


def human_truth(fx):
    """(samples, worksheet, verified_empty, notes): a worksheet over all turns with nothing wrong in it."""
    c = fx.table("conversations").withColumn("sample_id", F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 6, "0")))
    empty = (F.col("turn") % 3 == 0) | (F.length(F.trim("text")) == 0)
    said = F.element_at(F.array(*[F.lit(t) for t in ("None", "  ", "EMPTY", "no student answer text")]), (F.col("conv_id") % 4 + 1).cast("int"))
    samples = c.select(F.concat(F.lit("p"), (F.col("conv_id") % 20).cast("string")).alias("dataset_id"), "sample_id", F.lit("seen").alias("notes"))
    return samples, c.select("sample_id", F.when(empty, said).otherwise(F.col("text")).alias("entered_text")), c.where(empty).select("sample_id"), c.where("turn % 2 = 0").select("sample_id", F.col("role").alias("note"))


@query("e17_freeze_ground_truth", f"with {_TRUTH} select dataset_id, sample_id, st ground_truth_status, md5(body) digest, notes from g")
def _(fx):
    store = SnapshotStore(fx.spark, new_root(fx, "truth"))
    record = Z.freeze_ground_truth_set(store, *human_truth(fx), ["dataset_id"], form=P.tree_fingerprint)
    return store.load(record["fingerprint"], "ground_truth").select("dataset_id", "sample_id", "ground_truth_status", F.md5(F.col("ground_truth_text").cast("binary")).alias("digest"), "notes")


@query("e18_reverification_status", f"""
    with {_APPROVALS}, s as (select distinct concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events where user_id%10<>0),
    a as (select * from ap where rn=1 and session_id='s1'), c as (select r.sample_id, sha256(record) fp from fx_records r join fx_current f on r.event_id=f.event_id)
    select coalesce(s.sample_id,a.sample_id) sample_id, case when s.sample_id is null then 'unknown_sample' when a.fp is null then 'missing' when a.fp=c.fp then 'valid' else 'changed' end status
    from s full outer join a on s.sample_id=a.sample_id left join c on c.sample_id=coalesce(s.sample_id,a.sample_id)""")
def _(fx):
    samples = fx.label_samples().where(F.substring("sample_id", 8, 6).cast("int") % 10 != 0)
    approved = L.approvals(ledger(fx), ORDER).where("session_id = 's1'")
    return L.reverification_status(samples, L.with_record(current(fx)), approved)


def _tree(name, key, ident, record, source):
    """The hash tree of a dataset in SQL; ``name`` becomes a table of key and fp."""
    levels = [f"{name}h as (select {key}, substr(sha256({ident}),1,10) node, {ident} o, sha256({record}) h from {source})"]
    before = f"{name}h"
    for digits in (*P.TREE_DIGITS[1:], 0):
        step = f"{name}{digits}"
        levels.append(f"{step} as (select k as {key}, n as node, n as o, h from (select {key} k, node n, sha256(string_agg(h,'' order by o)) h from {before} group by {key}, node))")
        before = step
        if digits:
            levels[-1] = levels[-1].replace("n as node, n as o", f"substr(n,1,{digits}) as node, n as o")
    return ",\n    ".join([*levels, f"{name} as (select {key}, sha256(string_agg(h,'' order by o)) fp from {before} group by {key})"])


_DAMAGED = "(select 1 as one, doc_id, case when lang='fr' then text||'!' else text end body from documents)"


@query("e19_integrity_gate", f"""
    with {_tree("was", "one", "cast(doc_id as varchar)", "text", "(select 1 as one, doc_id, text from documents)")},
    {_tree("now", "one", "cast(doc_id as varchar)", "body", _DAMAGED)}
    select 'corpus' as name, now.fp observed, was.fp expected from was, now where was.fp<>now.fp
    union all select 'absent', null, 'x' union all select 'languages', cast((select count(distinct lang) from documents) as varchar), '3' where (select count(distinct lang) from documents)<>3""")
def _(fx):
    store = SnapshotStore(fx.spark, new_root(fx, "integrity"))
    docs = fx.table("documents").select(F.lit("corpus").alias("corpus"), F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")

    def facts(corpus):
        return {"corpus": P.tree_fingerprint(corpus, ["corpus"], "doc_id", "text").select("fingerprint"), "documents": corpus.agg(F.count(F.lit(1))), "languages": corpus.agg(F.countDistinct("lang"))}

    known = {r["name"]: r["observed"] for r in Z.observe(facts(docs)).collect()}
    ds = F.lit("all").alias("dataset_id")
    labels = current(fx).select(ds, "*")
    samples = fx.label_samples().join(labels.select("sample_id"), "sample_id", "left_semi").select(ds, "*")
    record = Z.freeze_label_set(store, samples, labels, ["dataset_id"], facts={**known, "languages": 3}, form=P.tree_fingerprint)
    # Since then every French text gained a character; the labels are as they were.
    later = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    again = Z.set_fingerprint(Z.label_provenance(samples, Z.verified(store, record["fingerprint"], ["dataset_id"], form=P.tree_fingerprint), ["dataset_id"], P.tree_fingerprint), ["dataset_id"])
    seen = Z.observe({**facts(later), "labels": fx.spark.range(1).select(F.lit(again))})
    return Z.integrity_gate(store, record["fingerprint"], seen, {"labels": record["fingerprint"], "absent": "x"})


@query("e20_frozen_benchmark_gate", f"""
    with {_TRUTH}, s as (
      select dataset_id, sample_id, case when dataset_id='p3' and sample_id like '%0' then 'pending' else st end st, case when dataset_id='p4' then body||'.' else body end body from g where dataset_id<>'p7'
      union all select 'p5', 'extra', 'verified', 'x' union all select 'p99', 'new', 'verified', 'y'),
    r as (select dataset_id, '{{"sample_id":"'||sample_id||'","status":"'||st||'","student_text":'||to_json(body)||'}}' rec, sample_id from s),
    {_tree("fp", "dataset_id", "sample_id", "rec", "r")},
    f as (select dataset_id, count(*) n, count(*) filter (where st='pending') p from s group by 1), k as (select dataset_id, count(*) n from g group by 1)
    select coalesce(f.dataset_id, k.dataset_id) dataset_id, f.n sample_count, f.p pending_count, fp.fp fingerprint,
      case when k.n is null then 'not_frozen' when f.n is null or f.p>0 or f.n<>k.n then 'not_ready' when f.dataset_id='p4' then 'fingerprint_mismatch' end blocked_by
    from f full join k on f.dataset_id=k.dataset_id left join fp on fp.dataset_id=f.dataset_id""")
def _(fx):
    store = SnapshotStore(fx.spark, new_root(fx, "gate"))
    record = Z.freeze_ground_truth_set(store, *human_truth(fx), ["dataset_id"], form=P.tree_fingerprint)
    rows = store.load(record["fingerprint"], "ground_truth").select("dataset_id", "sample_id", "ground_truth_status", "ground_truth_text")
    # Most papers are as frozen; p3 is pending again, p4 has other text, p5 one sample more, p7 is lost, p99 was never frozen.
    paper = F.col("dataset_id")
    now = rows.where(paper != "p7").withColumn("ground_truth_status", F.when((paper == "p3") & F.col("sample_id").endswith("0"), "pending").otherwise(F.col("ground_truth_status")))
    now = now.withColumn("ground_truth_text", F.when(paper == "p4", F.concat("ground_truth_text", F.lit("."))).otherwise(F.col("ground_truth_text")))
    more = fx.spark.createDataFrame([("p5", "extra", "verified", "x"), ("p99", "new", "verified", "y")], now.schema)
    return Z.gate_frozen_benchmark(store, record["fingerprint"], now.unionByName(more), ["dataset_id"], P.tree_fingerprint)


@query("e22_labelled_datasets", "select distinct lang dataset_id from documents where lang in (select case when user_id%2=0 then 'en' else 'xx' end from events where event_type='click')")
def _(fx):
    labels = fx.table("events").where("event_type = 'click'").select(F.when(F.col("user_id") % 2 == 0, "en").otherwise("xx").alias("dataset_id"))
    return L.labelled_datasets(fx.table("documents").select(F.col("lang").alias("dataset_id")).distinct(), labels)


