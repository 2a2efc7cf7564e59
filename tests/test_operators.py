import random

from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.operators import audit, evaluate, layout, learning, replay, review, templates
from garimi.operators import findings as G
from garimi.plans import queries


def test_replay_against_plain_fold(spark):
    r = random.Random(3)
    rows = []
    for c in range(600):
        word = "뜨거운" if r.random() < 0.4 else f"w{r.randrange(40)}"
        rows.append((c, word, "제외", r.choice(["반영", "정정", "취소"]), r.choice([None, r.randrange(9)]), f"2033-01-{r.randrange(1, 20):02d}T0{r.randrange(9)}:00:00"))
    feed = rows + r.sample(rows, 200)
    r.shuffle(feed)
    log = spark.createDataFrame(feed, "change_id long, word string, direction string, event string, hit_count int, ts string")
    want = {}
    for c, w, _, e, h, _t in sorted(rows, key=lambda x: (x[5], x[0])):
        if e == "반영":
            want[w] = (c, h)
        elif e == "취소":
            want.pop(w, None)
        elif w in want:
            want[w] = (c, want[w][1] if h is None else h)
    for parts in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x.word: (x.change_id, x.hit_count) for x in replay.replay(replay.valid_changes(log)).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_replay_dirt(spark):
    rows = [(1, " 가 ", "제외", "반영 ", None, "2033-01-01 09:00:00"), (2, "가", "제외", "정정", 5, "2033-01-01T00:00:00Z"), (3, None, "제외", "반영", 1, "2033-01-01T00:00:00"), (4, "나", "제외", "반영", 1, " "), (5, "나", " ", "반영", 1, "2033-01-01T00:00:00"), (6, "나", "제외", "반영", 1, "later"), (7, "나", "제외", "다른", 1, "2033-01-01T00:00:00")]
    schema = "change_id long, word string, direction string, event string, hit_count int, ts string"
    log = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in replay.replay(replay.valid_changes(log)).collect()] == [("가", "제외", 2, 5)]
    assert replay.replay(replay.valid_changes(spark.createDataFrame([], schema))).count() == 0
    extra = log.withColumn("at", F.lit("clash")).withColumn("key", F.lit(1))
    assert replay.replay(replay.valid_changes(extra)).count() == 1


F_SCHEMA = "finding_id long, doc_id long, type string, value string, start_pos int, end_pos int, grp string, approved boolean, confidence string, confidence_ord int, source string, emit_ord int"
S_SCHEMA = "span_id long, doc_id long, span_ord int, page_index int, text string, origin struct<x:double,y:double>, bbox struct<x0:double,y0:double,x1:double,y1:double>, fontsize double, start_pos int, end_pos int, dir struct<dx:double,dy:double>"


def span(i, doc, text, start, x=72.0, y=72.0, page=0):
    return (i, doc, i, page, text, (x, y + 10), (x, y, x + 9.9 * len(text), y + 14), 11.0, start, start + len(text), (1.0, 0.0))


def test_interval_join_equals_brute_force(spark):
    r = random.Random(1)
    f = [(i, i % 3, "이름", "x", s := r.randrange(3000), s + r.randrange(0, 900), "기본", True, "중간", 1, "자동", i) for i in range(60)]
    s = [span(i, i % 3, "가" * r.randrange(0, 700), r.randrange(3000)) for i in range(60)]
    got = {(x.finding_id, x.s_span_id) for x in layout.spans_covering(spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(s, S_SCHEMA)).collect()}
    want = {(a[0], b[0]) for a in f for b in s if a[1] == b[1] and b[8] < a[5] and b[9] > a[4] and a[4] < a[5] and b[8] < b[9]}
    assert got == want and len(want) > 20
    n = layout.spans_covering(spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(s, S_SCHEMA)).count()
    assert n == len(want)


def test_next_unconfirmed_wraps(spark):
    rows = [(i, 1, "이름", "x", i, i + 1, "기본", True, c, {"낮음": 0, "높음": 2}[c], "자동", i) for i, c in enumerate(["낮음", "높음", "높음"])]
    got = {r.finding_id: r.next_id for r in G.next_unconfirmed(spark.createDataFrame(rows, F_SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


DOCS = {
    1: [("성명: 홍길동", 72, 72), ("전화번호: 010-1111-2222", 72, 100)],
    2: [("성명: 김철수", 72, 72), ("전화번호: 010-9999-8888", 72, 100)],
    3: [("주소: 서울특별시 강남구 테헤란로 1", 300, 500)],
    4: [("성명: 짜장면", 72, 72), ("전화번호: 010-3333-4444", 72, 100)],
    5: [("성명: 박영희", 72, 72), ("전화번호: 010-5555-4444", 72, 100), ("이메일: test@example.com", 72, 140)],
}


def forms(spark, *ids):
    from garimi.operators import detect

    docs, spans = [], []
    for d in ids:
        text = ""
        for line, x, y in DOCS[d]:
            spans.append(span(len(spans), d, line, len(text), float(x), float(y)))
            text += line + "\n"
        docs.append((d, text, "기타"))
    docs = spark.createDataFrame(docs, "doc_id long, text string, doc_type string")
    found = detect.findings(docs).withColumn("finding_id", F.monotonically_increasing_id())
    return docs, spark.createDataFrame(spans, S_SCHEMA), found


def sizes(spans):
    return spans.select("doc_id", "page_index").distinct().withColumn("width", F.lit(595.0)).withColumn("height", F.lit(842.0))


def learned(spark, *ids):
    docs, spans, found = forms(spark, *ids)
    p = sizes(spans)
    return templates.fold_templates(templates.signatures(templates.anchors(docs, spans, p), templates.item_positions(found, spans, docs, p))).cache()


def test_templates(spark):
    t = learned(spark, 1)
    docs, spans, found = forms(spark, 2, 3, 4)
    p = sizes(spans)
    a = templates.anchors(docs, spans, p)
    assert {r.doc_id: r.score for r in templates.best_match(a, templates.anchors_of(t)).collect()} == {2: 1.0, 4: 1.0}
    got = templates.suggestions(templates.best_match(a, templates.anchors_of(t)), templates.items_of(t), templates.item_positions(found, spans, docs, p), spans, found, p)
    assert [tuple(r) for r in got.collect()] == [(4, "이름", "짜장면", 4, 7)]
    assert templates.anchors(docs, spans, p.limit(0)).count() == 0


def test_templates_merge(spark):
    t = learned(spark, 1, 5)
    assert {(r.template_id, r.sample_count) for r in t.collect()} == {(1, 2)}
    assert "이메일" in {r.type for r in t.collect()}


def test_one_store_in_true_order(spark):
    """Against a plain fold over all documents: a copy of an early form may belong to a later template by then."""
    r = random.Random(12)
    pool = [(0, name, x, 1) for x in range(4) for name in "가나다라"]
    docs = {d: r.sample(pool, r.randrange(2, 7)) for d in range(120)}
    for d in range(60, 120):
        docs[d] = docs[d - 60] if r.random() < 0.5 else docs[d]
    rows = [(d, [dict(zip(templates.ANCHOR, x, strict=True)) for x in xs], [(0, 0, "이름", *x[:1], x[2], 1, "")for x in xs[:1]]) for d, xs in docs.items()]
    schema = "doc_id long, anchors array<struct<page_index:int,label:string,xb:int,yb:int>>, items array<struct<start_pos:int,finding_id:long,type:string,page_index:int,xb:int,yb:int,label:string>>"
    sig = spark.createDataFrame([(d, [tuple(a.values()) for a in xs], i) for d, xs, i in rows], schema).repartition(5)
    want: list[list] = []
    for d in sorted(docs):
        mine = set(docs[d])
        scores = [(len(mine & t[1]) / len(mine | t[1]) if len(mine & t[1]) > 1 else 0.0, -k) for k, t in enumerate(want)]
        best = max(scores, default=(0.0, 0))
        if best[0] >= 0.6:
            want[-best[1]][1] |= mine
            want[-best[1]][2] += 1
        else:
            want.append([d, set(mine), 1])
    got = templates.fold_templates(sig)
    assert {x.template_id: x.sample_count for x in got.collect()} == {t[0]: t[2] for t in want}
    held = {}
    for x in templates.anchors_of(got).collect():
        held.setdefault(x.template_id, set()).add((x.page_index, x.label, x.xb, x.yb))
    assert held == {t[0]: t[1] for t in want}
    # Matching: prefixes and classes of equal sets against all pairs.
    a = spark.createDataFrame([(d, *x) for d, xs in docs.items() for x in set(xs)], "doc_id long, page_index int, label string, xb int, yb int")
    best = {}
    for d, xs in docs.items():
        scores = [(len(set(xs) & t[1]) / len(set(xs) | t[1]), -t[0]) for t in want if len(set(xs) & t[1]) > 1]
        if scores and max(scores)[0] >= 0.6:
            best[d] = (-max(scores)[1], max(scores)[0])
    assert {x.doc_id: (x.template_id, x.score) for x in templates.best_match(a, templates.anchors_of(got)).collect()} == best


def test_match_of_many_anchors(spark):
    """Sets around the size from which they meet by single anchors, against all pairs."""
    r = random.Random(4)
    pool = [(0, "가", x, y) for x in range(15) for y in range(10)]
    sets = {d: set(r.sample(pool, n)) for d, n in enumerate([2, 3, 20, 24, 25, 30, 39, 40, 41, 60, 66, 90])}
    for d in range(12, 60):
        sets[d] = set(r.sample(sorted(sets[d % 12]), max(2, round(len(sets[d % 12]) * r.uniform(0.55, 1))))) | set(r.sample(pool, r.randrange(8)))
    rows = lambda ids, key: spark.createDataFrame([(d, *x) for d in ids for x in sets[d]], f"{key} long, page_index int, label string, xb int, yb int")
    want = {}
    for d in range(12, 60):
        scores = [(len(sets[d] & sets[t]) / len(sets[d] | sets[t]), -t) for t in range(12) if len(sets[d] & sets[t]) > 1]
        if scores and max(scores)[0] >= 0.6:
            want[d] = (-max(scores)[1], max(scores)[0])
    got = templates.best_match(rows(range(12, 60), "doc_id"), rows(range(12), "template_id"))
    assert len(want) > 15 and {x.doc_id: (x.template_id, x.score) for x in got.collect()} == want


def test_nothing_exploded_is_broadcast(spark):
    """Items go to the documents, and anchors to their sets, without a broadcast that grows with the input."""
    docs, spans, found = forms(spark, 2, 3, 4)
    p = sizes(spans)
    t = learned(spark, 1)
    matched = templates.best_match(templates.anchors(docs, spans, p), templates.anchors_of(t))
    got = templates.suggestions(spark.createDataFrame(matched.collect(), matched.schema), templates.items_of(t), templates.item_positions(found, spans, docs, p), spans, found, p)

    def broadcasts(node, inside=False):
        name = node.nodeName()
        inside = (inside or "BroadcastExchange" in name) and name != "Exchange"
        below = node.children()
        return [name] * (inside and "Generate" in name) + [x for i in range(below.size()) for x in broadcasts(below.apply(i), inside)]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert not broadcasts(got.select("*")._jdf.queryExecution().executedPlan())
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_names_by_a_large_dictionary(spark, tmp_path):
    """More learned words than a plan can hold: all of them count."""
    put = lambda i, w, direction: (i, i, w, direction, "반영", 3, "2033-01-01T00:00:00")
    learned_ = [f"{a}{b}{c}" for a in "쀼쁘뿌" for b in map(chr, range(0xAC00, 0xAC00 + 90)) for c in map(chr, range(0xB000, 0xB000 + 90))]
    rows = [put(i, w, D.NAME_DIRECTION) for i, w in enumerate(learned_)] + [put(90_000, "김가람", D.EXCLUDE_DIRECTION), put(90_001, f"{learned_[-1]}라", D.EXCLUDE_DIRECTION)]
    spark.createDataFrame(rows, "log_id long, change_id long, word string, direction string, event string, hit_count int, ts string").write.parquet(f"{tmp_path}/promotion_log.parquet")
    text = f"성명: {learned_[-1]}\n성명: {learned_[7]}나\n성명: {learned_[-1]}라\n성명: 김가람\n성명: 김나람\n성명: 뽀가각\n팀장 {learned_[9]}\n"
    spark.createDataFrame([(1, text, "기타", None)], "doc_id long, text string, doc_type string, received_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["u5_learned_names"](spark, str(tmp_path)).collect()
    want = [learned_[-1], f"{learned_[7]}나", "김나람", learned_[9]]
    assert len(learned_) > 20_000 and [r.value for r in sorted(got, key=lambda r: r.start_pos)] == want
    assert all(text[r.start_pos :].startswith(r.value) for r in got)


def test_undo_redo_of_large_ids(spark, tmp_path):
    """Finding ids beyond 2^31 are an order like any other."""
    base = 7 * 2**31 * 60
    rows = [(base + i, 1, "이름", "x", i, i + 1, "기본", True, "낮음", 0, "자동", i) for i in (1, 3, 4, 6)]
    spark.createDataFrame(rows, F_SCHEMA).write.parquet(f"{tmp_path}/findings.parquet")
    got = queries.QUERIES["r6_undo_redo"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.target, r.approve) for r in got} == {(1, 0, False), (1, 2, True)}


def test_undo_redo(spark):
    rows = [(1, 1, "set", 7, True), (1, 2, "set", 7, False), (1, 3, "undo", None, None), (1, 4, "redo", None, None), (1, 5, "undo", None, None), (1, 6, "set", 8, True), (1, 7, "redo", None, None), (2, 1, "undo", None, None), (2, 2, "set", 9, True)]
    got = {(r.doc_id, r.target): r.approve for r in review.undo_redo(spark.createDataFrame(rows, "doc_id long, seq int, kind string, target long, approve boolean")).collect()}
    assert got == {(1, 7): True, (1, 8): True, (2, 9): True}


def test_accuracy_of_rules(spark):
    marked = ["신청인: {{김철수}} (010-1234-5678)\n주소: [[서울특별시 강남구 테헤란로 45]]\n", "이름: {{박민수}}\n", "협조자: {{서인천지사}}\n", "성명: {{남궁민}}\n", "본 건은 서울특별시 소재 국세청 관할\n", None, ""]
    cases = spark.createDataFrame(list(enumerate(marked)), "case_id long, marked_text string")
    got = {r.type: (r.hits, r.predicted, r.gold) for r in evaluate.accuracy(cases).collect()}
    assert got == {"이름": (2, 3, 4), "주소": (1, 1, 1)}


def test_promotions_and_epochs(spark):
    rows = [(i, 1, w, "제외", f"2033-01-0{i + 1}T00:00:00") for i, w in enumerate(["가", " 가", "나", "가", "가", None, "나"])] + [(0, 1, "가", "제외", "2033-01-01T00:00:00")]
    c = spark.createDataFrame(rows, "event_id long, doc_id long, word string, direction string, ts string")
    assert [tuple(r) for r in learning.promotions(c, learning.base_dictionary(spark)).collect()] == [("가", "제외", 3)]
    held = spark.createDataFrame([("가", "제외")], "word string, direction string")
    assert learning.promotions(c, held).count() == 0 and not [r for r in learning.promotions(c.withColumn("direction", F.lit("다른")), held.limit(0)).collect()]
    known = spark.createDataFrame([(i, 1, w, k, f"2033-01-0{i % 9 + 1}T00:00:00") for i, (w, k) in enumerate([("감사팀", "제외"), ("김", "이름후보"), ("김", "제외")] * 3)], c.schema)
    assert [(r.word, r.direction) for r in learning.promotions(known, learning.base_dictionary(spark)).collect()] == [("김", "제외")]
    log = spark.createDataFrame([(1, "가", "제외", "취소", 0, "2033-01-02T12:00:00")], "change_id long, word string, direction string, event string, hit_count int, ts string")
    assert {r.word: (r.n_since, r.promote) for r in learning.epochs(c, log, learning.base_dictionary(spark)).collect()} == {"가": (2, False), "나": (2, False)}


def test_output_and_unique_names(spark):
    batch = spark.createDataFrame([(1, "민원", "20330101"), (2, None, "20330101"), (3, "계약/1", "20330102")], "doc_id long, doc_type string, day string")
    old = spark.createDataFrame([("기타_20330101_1007.pdf",), ("x",), (None,)], "output_filename string")
    assert [r.output_filename for r in audit.output_names(batch, old).orderBy("doc_id").collect()] == ["민원_20330101_1008.pdf", "기타_20330101_1009.pdf", "계약_1_20330102_001.pdf"]
    files = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b"), (4, "b")], "id long, name string")
    assert [r.dest for r in audit.unique_names(files).orderBy("id").collect()] == ["a.pdf", "a(1).pdf", "b", "b(1)"]


def test_unique_names_skip_taken_numbers(spark):
    files = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "a(1).pdf"), (4, "a.pdf"), (5, None), (None, "a.pdf")], "id long, name string")
    assert [r.dest for r in audit.unique_names(files).orderBy("id").collect()] == ["a.pdf", "a(1).pdf", "a(1)(1).pdf", "a(2).pdf"]
    there = spark.createDataFrame([("a.pdf",), ("a(2).pdf",)], "name string")
    assert [r.dest for r in audit.unique_names(files, there).orderBy("id").collect()] == ["a(1).pdf", "a(3).pdf", "a(1)(1).pdf", "a(4).pdf"]
    r = random.Random(8)
    rows = [(i, r.choice(["a.pdf", "a(1).pdf", "a(2).pdf", "a(1)(1).pdf", "b", "b(3)", "c.x"])) for i in range(120)]
    taken, want = {"b", "b(1)"}, []
    for _, name in rows:
        stem, dot, end = name.partition(".")
        n = 0
        while (dest := f"{stem}{f'({n})' if n else ''}{dot}{end}") in taken:
            n += 1
        taken.add(dest)
        want.append(dest)
    got = audit.unique_names(spark.createDataFrame(rows, "id long, name string"), spark.createDataFrame([("b",), ("b(1)",)], "name string"))
    assert [x.dest for x in got.orderBy("id").collect()] == want


def test_originals_by_stem_and_suffix(spark):
    log = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "c"), (4, "d.pdf"), (5, None), (6, "e.pdf")], "audit_id long, original_filename string")
    kept = spark.createDataFrame([("a_v2.pdf",), ("a_v3.pdf",), ("b.pdf",), ("b(1).pdf",), ("c.hwp",), ("d.hwp",), (None,)], "name string")
    got = {r.audit_id: r.kept_as for r in audit.originals(log, kept).collect()}
    assert got == {1: "a_v2.pdf", 2: "b.pdf", 3: "c.hwp", 4: None, 5: None, 6: None}


def test_attachment_marks_all_pages(spark):
    pages = spark.createDataFrame([(1, 0, False, False, 0, False), (1, 1, False, False, 1, False), (1, 2, False, False, 0, False), (2, 0, True, False, 0, False), (2, 1, False, False, 0, False), (3, 0, None, None, None, None)], "doc_id long, page_index int, has_annot boolean, has_widget boolean, embfile_count int, has_ocg boolean")
    assert {tuple(r) for r in layout.hidden_content_pages(pages).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_folders_and_trust_report_empty(spark):
    f = spark.createDataFrame([], "doc_id long, approved boolean, source string")
    d = spark.createDataFrame([], "doc_id long, doc_type string, received_at timestamp")
    assert audit.trust_report(f, d).filter("span <> 'all'").count() == 0


def test_reports_hold_no_values(spark):
    log = spark.createDataFrame([(1, "2033-01-01 00:00:00", "p", "a.pdf", "h", "o.pdf", "이름:2;전화번호:1", True, False, 12.34)], "audit_id long, logged_at string, processor string, original_filename string, original_sha256 string, output_filename string, masked_counts string, rotated_text_warning boolean, hidden_content_warning boolean, review_seconds double")
    text = audit.summary(log).first().report
    assert "  - 이름: 2건\n  - 전화번호: 1건" in text and "회전된" in text and "숨겨진" not in text
    assert audit.history(log).first().rotated_text == audit.FLAG


def test_numbering_in_blocks_equals_row_number(spark):
    from pyspark.sql import Window

    from garimi.operators.ranking import numbered

    r = random.Random(9)
    rows = [("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), i) for i in r.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, id long")
    got = numbered(df, ["k"], F.floor(F.col("id") / 100), ["id"], "n").withColumn("m", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert got.count() == 400 and got.filter("n <> m").count() == 0


def test_clicks_and_drags_meet_words_of_any_direction(spark):
    rows = [span(0, 1, "가나 다라", 0, x=10.0, y=60.0), (1, 1, 1, 0, "세로 글", (300.0, 100.0), (290.0, 100.0, 302.0, 140.0), 10.0, 6, 10, (0.0, 1.0)), (2, 1, 2, 0, "x", (1.0, 1.0), None, 10.0, 11, 12, (1.0, 0.0))]
    words = layout.words_of(spark.createDataFrame(rows, S_SCHEMA))
    got = {r.word: (r.start_pos, round(r.x0), round(r.y0), round(r.x1), round(r.y1)) for r in words.collect()}
    assert got == {"가나": (0, 10, 60, 30, 74), "다라": (3, 40, 60, 60, 74), "세로": (6, 290, 100, 302, 118), "글": (9, 290, 127, 302, 136)}
    clicks = spark.createDataFrame([(1, 1, 0, 295.0, 130.0), (2, 1, 0, 45.0, 65.0), (3, 1, 0, 500.0, 65.0)], "click_id long, doc_id long, page_index int, px double, py double")
    assert {r.click_id: r.word for r in layout.word_at(clicks, words).collect()} == {1: "글", 2: "다라"}
    drags = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 595.0, 842.0), (2, 1, 0, 280.0, 90.0, 310.0, 120.0), (3, 1, 0, 400.0, 1.0, 410.0, 9.0)], "drag_id long, doc_id long, page_index int, rx0 double, ry0 double, rx1 double, ry1 double")
    assert {r.drag_id: (r.start_pos, r.end_pos) for r in layout.region_of(drags, words).collect()} == {1: (0, 10), 2: (6, 8)}
