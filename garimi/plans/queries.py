"""The engine's queries, over the whole tables of a folder.

Tables without a counterpart on disk (clicks, decisions, page flags, results of a batch) are derived
here from the tables that exist, by arithmetic on ids, so that every operator runs over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi import patterns as P
from garimi.functions import masking as M
from garimi.functions.offsets import each, occurrences
from garimi.functions.text import line_end, line_start, strip_ws
from garimi.operators import audit, detect, evaluate, findings as G, layout, learning, replay, review, templates, verify
from garimi.sources import files
from garimi.sources.tables import table
from garimi.staging import scratch_folder, spread, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "doc_type", "received_at"))


def _findings(s: SparkSession, d: str) -> DataFrame:
    """Findings, each row once."""
    return table(s, d, "findings").distinct()


def _spans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spans").distinct()


def _names(f: DataFrame) -> DataFrame:
    return f.select("finding_id", "doc_id", "type", "value", "start_pos", "end_pos")


@query
def flagship(s, d):
    """Detect, mask and verify every document; findings and leftovers by document type and type."""
    m = verify.masked(_docs(s, d), "doc_type")
    rows = each(m, F.arrays_zip(F.transform("found", lambda f: f["type"]).alias("type"), M.standing(F.col("masked"), F.col("found")).alias("left")), "x", "doc_type")
    return rows.groupBy("doc_type", F.col("x.type").alias("type")).agg(F.count("*").alias("n_findings"), F.count_if("x.left").alias("n_left"))


def _plain(s, d, array):
    rows = each(_docs(s, d), array, "f", "doc_id")
    return rows.select("doc_id", "f.value", "f.start_pos", "f.end_pos")


for _name, _detector in (("d1_phone", detect.phones), ("d2_email", detect.emails), ("d3_rrn", detect.rrns), ("d5_passport", detect.passports), ("d6_account", detect.accounts), ("d7_card", detect.cards), ("n7_address", detect.addresses)):
    QUERIES[_name] = lambda s, d, f=_detector: _plain(s, d, f(F.col("text")))


@query
def d4_rrn_checksum(s, d):
    v = each(_docs(s, d), occurrences(F.col("text"), P.RRN, "-"), "m").select("m.value").distinct()
    return v.select("value", detect.rrn_valid(F.col("value")).alias("valid"))


@query
def d8_line_span(s, d):
    rows = each(_docs(s, d), detect.phones(F.col("text")), "f", "doc_id", "text")
    pos = F.col("f.start_pos")
    return rows.select("doc_id", pos.alias("start_pos"), line_start(F.col("text"), pos).alias("line_start"), line_end(F.col("text"), pos).alias("line_end"))


@query
def d9_classify(s, d):
    return _findings(s, d).select("value").filter("value is not null").distinct().select("value", detect.classify(F.col("value")).alias("kind"))


@query
def d10_occurrences(s, d):
    return review.occurrences_of(_findings(s, d).filter("value <> ''"), _docs(s, d))


@query
def n1_after_labels(s, d):
    rows = each(_docs(s, d), detect.after_labels(F.col("text"), P.NAME_LABEL), "w", "doc_id")
    return rows.select("doc_id", "w.value", "w.start_pos")


@query
def n2_surname_word(s, d):
    words = n1_after_labels(s, d).select("value").distinct()
    return words.select("value", detect.surname_word(F.col("value")).alias("is_name"))


@query
def n6_names(s, d):
    rows = each(_docs(s, d), detect.names(F.col("text")), "f", "doc_id")
    return rows.select("doc_id", "f.value", "f.start_pos", "f.grp", "f.confidence")


@query
def n8_hints(s, d):
    rows = each(_docs(s, d), detect.hints(F.col("text"), detect.detect_all("text")), "f", "doc_id")
    return rows.select("doc_id", "f.type", "f.value", "f.start_pos", "f.grp")


@query
def g1_union(s, d):
    """Every finding of every rule, in their order, before any is dropped."""
    rows = detect.exploded(_docs(s, d), detect.raw_findings(F.col("text")))
    return rows.select("doc_id", "emit_ord", "type", "value", "start_pos", "grp")


@query
def g2_first_of_span(s, d):
    return G.first_of_span(_findings(s, d), "emit_ord", "finding_id").select("finding_id", "doc_id", "start_pos", "end_pos")


@query
def g3_document_order(s, d):
    return G.document_order(_findings(s, d)).select("finding_id", "position")


@query
def g4_review_order(s, d):
    return G.review_order(_findings(s, d)).select("finding_id", "review_position")


@query
def g5_next_unconfirmed(s, d):
    return G.next_unconfirmed(_findings(s, d))


@query
def g6_counts_by_type(s, d):
    return G.counts_by_type(_findings(s, d))


@query
def g7_findings_per_page(s, d):
    f = _findings(s, d)
    return layout.page_of(f, _spans(s, d)).join(f.select("finding_id", "doc_id"), "finding_id").groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query
def g8_history(s, d):
    return audit.history(table(s, d, "audit_log"))


@query
def g9_originals(s, d):
    return audit.originals(table(s, d, "audit_log"), table(s, d, "archived_keys").filter("original_filename is not null").select(F.col("original_filename").alias("name")))


@query
def g10_recent_promotions(s, d):
    return learning.recent_promotions(table(s, d, "promotion_log"))


@query
def g11_batch_summary(s, d):
    codes = table(s, d, "audit_log").select((F.when(F.col("audit_id") % 5 == 0, F.col("audit_id") % 9).otherwise(0)).cast("int").alias("code"))
    return audit.batch_summary(codes)


@query
def g12_accuracy(s, d):
    return evaluate.accuracy(table(s, d, "gold_cases"))


@query
def g12_misses(s, d):
    return evaluate.misses(table(s, d, "gold_cases"))


@query
def g13_trust_report(s, d):
    return audit.trust_report(_findings(s, d), table(s, d, "documents"))


@query
def x_detect_all(s, d):
    return detect.findings(_docs(s, d)).select("doc_id", "type", "value", "start_pos", "end_pos", "grp", "confidence", "confidence_ord", "cross_validated", "source", "emit_ord")


@query
def x1_bumped_names(s, d):
    return detect.findings(_docs(s, d)).filter(f"cross_validated and grp <> '{D.GROUP_CROSS}'").select("doc_id", "value", "start_pos", "grp", "confidence")


def _named_twice(s, d):
    """The documents, each followed by two lines that a form with a second signatory would have."""
    return _docs(s, d).filter("text is not null").withColumn("text", F.concat("text", F.lit("\n성명: 김가람\n성명: 쀼"), F.lit("룽이\n")))


@query
def x2_candidates(s, d):
    return detect.findings(_named_twice(s, d)).filter(F.col("grp") == D.GROUP_CROSS).select("doc_id", "value", "start_pos")


@query
def m1_m8_masks(s, d):
    v = F.col("value")
    rows = _findings(s, d).select("value").filter("value <> ''").distinct()
    return rows.select("value", M.mask_name(v).alias("as_name"), M.mask_phone(v).alias("as_phone"), M.mask_email(v).alias("as_email"), M.mask_address(v).alias("as_address"), M.mask_full(v).alias("as_full"), M.mask_keep_last(v).alias("as_account"), M.mask_keep_ends(v).alias("as_card"), M.mask_rrn(v).alias("as_rrn"))


@query
def m9_mask_by_type(s, d):
    return _findings(s, d).select("finding_id", "type", M.mask_value(F.col("type"), F.col("value")).alias("mask"))


@query
def m10_full_policy(s, d):
    policy = M.Policy(account_card_full=True, rrn_full=True)
    return _findings(s, d).filter(F.col("type").isin(D.ACCOUNT, D.CARD, D.RRN)).select("finding_id", M.mask_value(F.col("type"), F.col("value"), policy).alias("mask"))


@query
def m11_masked_text(s, d):
    return verify.masked(_docs(s, d)).select("doc_id", "masked")


@query
def l1_spans_covering(s, d):
    return layout.spans_covering(_names(_findings(s, d)), _spans(s, d)).select("finding_id", F.col("s_span_id").alias("span_id"))


@query
def l2_page_of(s, d):
    return layout.page_of(_findings(s, d), _spans(s, d))


@query
def l3_rect_plans(s, d):
    r = layout.rect_plans(_names(_findings(s, d)), _spans(s, d))
    return r.select("finding_id", "span_id", "page_index", "seg_lo", "seg_hi", "rotate", *[F.round(c, 3).alias(c) for c in ("baseline_x", "baseline_y", "x0", "y0", "x1", "y1")])


@query
def l4_rotation(s, d):
    return _spans(s, d).select("span_id", layout.rotation(F.col("dir.dx"), F.col("dir.dy")).alias("rotate"))


def _pages(s, d):
    p = _spans(s, d).select("doc_id", "page_index").distinct()
    k = F.col("doc_id")
    first = F.col("page_index") == 0  # an attachment and a layer are noted on one page only, and mark all
    return p.withColumns({"has_annot": (k + F.col("page_index")) % 7 == 0, "has_widget": (k % 11 == 0) & (F.col("page_index") == 1), "embfile_count": ((k % 13 == 0) & first).cast("int"), "has_ocg": (k % 17 == 0) & first})


@query
def l5_click_word(s, d):
    spans = _spans(s, d)
    clicks = spans.filter("bbox is not null").select(F.col("span_id").alias("click_id"), "doc_id", "page_index", (F.col("bbox.x0") + F.col("span_id") % 90).alias("px"), ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("py"))
    return layout.word_at(clicks, layout.words_of(spans)).select("click_id", "word", F.col("start_pos").cast("int").alias("start_pos"))


@query
def l6_drag_region(s, d):
    spans = _spans(s, d)
    b = lambda c: F.col(f"bbox.{c}")
    drags = spans.filter("bbox is not null").select(F.col("span_id").alias("drag_id"), "doc_id", "page_index", b("x0").alias("rx0"), b("y0").alias("ry0"), (b("x0") + 60 + F.col("span_id") % 100).alias("rx1"), b("y1").alias("ry1"))
    return layout.region_of(drags, layout.words_of(spans)).select("drag_id", F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))


@query
def l7_rotated_pages(s, d):
    return layout.rotated_pages(_spans(s, d))


@query
def l8_hidden_content_pages(s, d):
    return layout.hidden_content_pages(_pages(s, d))


@query
def l9_approval_gate(s, d):
    p = _pages(s, d)
    views = p.filter((F.col("doc_id") + F.col("page_index")) % 3 != 0).select("doc_id", "page_index", (F.col("doc_id") % 2 == 0).alias("on_canvas"))
    return layout.approval_gate(p, layout.hidden_content_pages(p).unionByName(layout.rotated_pages(_spans(s, d))), views)


@query
def l10_redaction_plan(s, d):
    return verify.redaction_plan(_findings(s, d), _docs(s, d)).select("finding_id", "mask", "mapped")


@query
def t3_label_before(s, d):
    f = _findings(s, d).join(_docs(s, d).filter("text is not null").select("doc_id", "text"), "doc_id")
    return f.select("finding_id", templates.label_before(F.col("text"), F.col("start_pos")).alias("label"))


def _sizes(s, d):
    """Pages with their size: some forms are set across."""
    across = F.col("doc_id") % 5 == 0
    p = _spans(s, d).select("doc_id", "page_index").distinct()
    return p.select("doc_id", "page_index", F.when(across, 842.0).otherwise(595.0).alias("width"), F.when(across, 595.0).otherwise(842.0).alias("height"))


@query
def t4_item_positions(s, d):
    return templates.item_positions(_names(_findings(s, d)), _spans(s, d), _docs(s, d), _sizes(s, d)).select("finding_id", "page_index", "xb", "yb")


@query
def t5_signatures(s, d):
    return templates.anchors(_docs(s, d), _spans(s, d), _sizes(s, d))


def _anchors(s, d):
    return staged(t5_signatures(s, d), "anchors")


def _forms(a):
    """Every document as a template of its own layout."""
    return a.withColumnRenamed("doc_id", "template_id")


@query
def t6_similarities(s, d):
    a = _anchors(s, d)
    return templates.similarities(a, _forms(a))


@query
def t7_best_match(s, d):
    """The best of all documents' layouts for each without its names' labels."""
    a = _anchors(s, d)
    return templates.best_match(a.filter("label <> '성명'"), _forms(a))


def _learned(s, d):
    docs, spans, sizes = _docs(s, d), _spans(s, d), _sizes(s, d)
    a = _anchors(s, d)
    f = _names(_findings(s, d).filter("approved and type is not null"))
    positions = staged(templates.item_positions(f, spans, docs, sizes), "positions")
    return a, positions, staged(templates.fold_templates(templates.signatures(a, positions)), "templates")


@query
def t8_learned_templates(s, d):
    return _learned(s, d)[2]


@query
def t12_suggestions(s, d):
    """What the learned templates add to the findings that were made automatically."""
    a, positions, learned = _learned(s, d)
    auto = _findings(s, d).filter(F.col("source") == D.SOURCE_AUTO)
    have = positions.join(auto.select("finding_id").distinct().hint("merge"), "finding_id", "left_semi")
    matched = staged(templates.best_match(a, templates.anchors_of(learned)), "matched")
    return templates.suggestions(matched, templates.items_of(learned), have, _spans(s, d), auto, _sizes(s, d))


@query
def u1_promotions(s, d):
    return learning.promotions(table(s, d, "candidate_events"), learning.base_dictionary(s))


@query
def u2_epochs(s, d):
    return learning.epochs(table(s, d, "candidate_events"), table(s, d, "promotion_log"), learning.base_dictionary(s))


@query
def u5_learned_names(s, d):
    """Names of all documents by the dictionary as it stands after the whole log."""
    return learning.learned_names(_docs(s, d), p4_state(s, d))


@query
def u3_learning_signals(s, d):
    return review.learning_signals(_findings(s, d))


def _decisions(s, d):
    """Two decisions on every automatic finding, the later one counting."""
    f = _findings(s, d).filter(F.col("source") == D.SOURCE_AUTO)
    return f.select("doc_id", "start_pos", "end_pos", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("doc_id", "start_pos", "end_pos", (F.col("start_pos") * 10 + F.col("k")).alias("seq"), ((F.col("start_pos") + F.col("k")) % 2 == 0).alias("approve"))


@query
def r1_apply_decisions(s, d):
    return review.apply_decisions(_findings(s, d), _decisions(s, d).distinct()).select("finding_id", "approved")


@query
def r2_set_all(s, d):
    orders = table(s, d, "documents").filter("doc_type = '민원'").select("doc_id", F.lit(1).alias("seq"), (F.col("doc_id") % 2 == 0).alias("approve"))
    return review.set_all(_findings(s, d), orders).select("finding_id", "approved")


@query
def r3_same_value(s, d):
    picked = _findings(s, d).filter("value <> '' and type is not null").select("doc_id", "type", "value")
    return review.same_value(_findings(s, d), picked, _docs(s, d)).select("doc_id", "value", "start_pos", "grp", "source")


def _added(s, d):
    f = _findings(s, d).filter("value <> ''")
    return f.select("doc_id", "value", (F.col("start_pos") + F.col("finding_id") % 2).cast("int").alias("start_pos"), (F.col("end_pos") + F.col("finding_id") % 2).cast("int").alias("end_pos"))


@query
def r4_manual_additions(s, d):
    return review.manual_additions(_findings(s, d), _added(s, d)).select("doc_id", "value", "start_pos", "type", "refused")


@query
def r4_retyped(s, d):
    a = _added(s, d)
    return review.retyped(_findings(s, d), a.select("doc_id", "start_pos", "end_pos", detect.classify(F.col("value")).alias("type")))


@query
def r5_search(s, d):
    terms = table(s, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("담당", "010-", "원"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("value"))
    return review.search(_findings(s, d), terms, _docs(s, d))


@query
def r6_undo_redo(s, d):
    """Each finding an action: most set a target, some undo; a redo directly after an undo takes it back."""
    k = F.col("finding_id")
    kind = F.when(k % 5 == 3, "undo").when(k % 7 == 5, "redo").otherwise("set")
    a = _findings(s, d).select("doc_id", k.alias("seq"), kind.alias("kind"), (k % 4).alias("target"), (k % 3 == 0).alias("approve"))
    return review.undo_redo(a)


@query
def r7_deleted(s, d):
    return review.deleted(_findings(s, d), _findings(s, d).filter(F.col("source") == D.SOURCE_MANUAL)).select("finding_id")


@query
def r8_retry(s, d):
    f = _findings(s, d)
    left = f.filter("not approved").select("doc_id", "value")
    return verify.retry_spans(f, left).select("finding_id")


@query
def v1_leftovers(s, d):
    """Every tenth document comes back from its writer as it was."""
    rows = verify.masked(_docs(s, d))
    return verify.leftovers(rows.withColumn("masked", F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(F.col("masked"))))


def _hidden(s, d):
    f = _findings(s, d).select("doc_id", F.lit("annot").alias("kind"), F.col("finding_id").alias("ord"), F.concat(F.lit("메모: 연락처 010-9999-8888, "), F.coalesce("type", F.lit("기타")), F.lit(": "), F.coalesce("value", F.lit(""))).alias("content"))
    return spread(f)


@query
def v3_hidden(s, d):
    return verify.scrub_hidden(_hidden(s, d)).select("ord", "n_found", "masked", "clean")


@query
def v3_redetected(s, d):
    return verify.redetected(verify.masked(_docs(s, d))).groupBy("type").agg(F.count("*").alias("n"))


@query
def v4_byte_residue(s, d):
    return verify.byte_residue(verify.masked(_docs(s, d)))


@query
def v5_gate(s, d):
    docs = _docs(s, d)
    return verify.gate(verify.redaction_plan(_findings(s, d), docs), verify.checks(verify.masked(docs)), verify.scrub_hidden(_hidden(s, d)), docs)


@query
def s1_rebuild_text(s, d):
    """Each page's text from its spans, in order, a line each."""
    lines = _spans(s, d).filter("text <> ''").groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("span_ord", "span_id", "text"))).alias("l"))
    return lines.select("doc_id", "page_index", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


@query
def s2_page_sizes(s, d):
    return _sizes(s, d)


@query
def s4_audit_log(s, d):
    """The audit log appended to a CSV log in two parts and read back."""
    path = scratch_folder(s, "audit-log")
    flag = lambda c: F.when(F.col(c), "True").otherwise("False").alias(c)
    log = table(s, d, "audit_log").select(F.col("logged_at").alias("timestamp"), "processor", "original_filename", "original_sha256", "output_filename", "masked_counts", flag("rotated_text_warning"), flag("hidden_content_warning"), F.col("review_seconds").cast("string").alias("review_seconds"), "audit_id")
    for part in (0, 1):
        files.append_audit_log(log.filter(F.col("audit_id") % 2 == part), path)
    return files.read_audit_log(s, path)


@query
def s5_learning_logs(s, d):
    """Candidates and promotions appended to their CSV logs and read back, counted by event."""
    a, b = scratch_folder(s, "candidates"), scratch_folder(s, "promotions")
    files.append_candidates(table(s, d, "candidate_events"), a)
    files.append_promotions(table(s, d, "promotion_log"), b)
    back = files.read_candidates(s, a).withColumn("event", F.lit("후보")).unionByName(files.read_promotions(s, b))
    return back.groupBy("word", "direction", "event").agg(F.count("*").alias("n"))


@query
def s6_template_store(s, d):
    """The learned templates written to a store (k10) and read back: their numbers of anchors and items."""
    path, learned = scratch_folder(s, "templates"), _learned(s, d)[2]
    anchor = F.array(F.col("page_index").cast("string"), "label", F.col("xb").cast("string"), F.col("yb").cast("string"))
    item = F.struct("type", "page_index", F.col("xb").alias("x_bucket"), F.col("yb").alias("y_bucket"), "label")
    store = learned.groupBy("template_id").agg(F.collect_list(F.when(F.col("kind") == "anchor", anchor)).alias("anchors"), F.collect_list(F.when(F.col("kind") == "item", item)).alias("items"), F.max("sample_count").alias("sample_count"))
    files.write_templates(store.select(F.col("template_id").cast("string").alias("id"), F.lit(1).alias("page_count"), "anchors", "items", "sample_count", F.lit("").alias("updated_at")), path)
    return files.read_templates(s, path).select(F.col("id").cast("long").alias("template_id"), F.size("anchors").alias("n_anchors"), F.size("items").alias("n_items"), "sample_count")


@query
def s8_failure_reason(s, d):
    m = F.element_at(F.array(*map(F.lit, ("Macro blocked", "파일 암호 필요", "Already open: in use", "CORRUPT header", "지원하지 않는 형식", "timeout"))), (F.col("audit_id") % 6 + 1).cast("int"))
    return table(s, d, "audit_log").select("audit_id", audit.failure_reason(m).alias("reason"))


@query
def s10_gold_spans(s, d):
    return evaluate.gold_spans(table(s, d, "gold_cases"))


@query
def k1_audit_rows(s, d):
    counts = G.count_map(_findings(s, d))
    x = table(s, d, "audit_log").join(counts, F.col("audit_id") == F.col("doc_id"))
    return audit.audit_rows(x).select("audit_id", "masked_counts")


@query
def k2_parse_counts(s, d):
    x = table(s, d, "audit_log").select("audit_id", F.explode(audit.parse_counts(F.col("masked_counts"))).alias("type", "n"))
    return x


@query
def k3_content_hash(s, d):
    return _docs(s, d).select("doc_id", audit.content_hash(F.col("text")).alias("sha256"))


@query
def k4_summary(s, d):
    return audit.summary(table(s, d, "audit_log"))


@query
def k5_output_names(s, d):
    batch = table(s, d, "documents").filter("received_at is not null").select("doc_id", "doc_type", F.date_format("received_at", "yyyyMMdd").alias("day"))
    return audit.output_names(batch, table(s, d, "audit_log").select("output_filename"))


@query
def k6_unique_names(s, d):
    files = table(s, d, "audit_log").filter("original_filename is not null").select(F.col("audit_id").alias("id"), F.trim("original_filename").alias("name"))
    there = table(s, d, "archived_keys").filter("original_filename is not null").select(F.trim("original_filename").alias("name"))
    return audit.unique_names(files, there).select("id", "dest")


@query
def k7_already_processed(s, d):
    k = F.col("audit_id")
    path = F.concat(F.when(k % 3 == 0, f"/작업/{D.FOLDERS['masked']}/").otherwise("/작업/입력/"), F.coalesce("output_filename", F.lit("")))
    words = F.when(k % 4 == 0, f"a, {D.PROCESSED_MARKER}").when(k % 4 == 1, "a")
    return table(s, d, "audit_log").select("audit_id", audit.already_processed(path, words).alias("processed"))


@query
def k8_processor(s, d):
    return table(s, d, "audit_log").select("audit_id", audit.processor(F.col("processor"), F.lit("user")).alias("processor"))


@query
def s3_dictionary(s, d):
    """Distinct trimmed words of the candidate log, as a dictionary file would hold them."""
    return table(s, d, "candidate_events").select(strip_ws(F.col("word")).alias("word")).filter("word <> ''").distinct()


@query
def p4_found(s, d):
    return p4_state(s, d).drop("hit_count")


@query
def p4_state(s, d):
    """The standing entries with all their columns."""
    return replay.replay(replay.valid_changes(table(s, d, "promotion_log")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
