from garimi.operators import evaluate

# The twelve marked texts that the published accuracy counts are taken over.
CORPUS = [
    "지출결의서\n신청인: {{김철수}} (010-1234-5678)\n입금계좌: 국민은행 123456-04-789012 (예금주: {{김철수}})\n주소: [[서울특별시 강남구 테헤란로 45]]\n",
    "출장신청서\n성명: {{이영희}}\n주소: [[경기도 수원시 팔달구 매산로 12]]\n",
    "민원처리결과\n민원인: {{정다은}}\n수령인: {{정다은}}\n",
    "감사팀장 {{홍길동}} 확인\n기안자: {{이감사}} / 검토: {{박팀장}} / 결재: {{최과장}}\n",
    "계약서\n가입자: {{강민준}}\n주소: [[부산광역시 해운대구 마린시티 105동 1502호]]\n",
    "출장신청서\n신청인: {{조은서}}\n주소: [[전라남도 순천시 조례동 123-4]]\n",
    "지출결의서\n신청인: {{윤아}}\n예금주: {{서준서연}}\n",
    "민원접수증\n이름: {{박민수}}\n",
    "담당부서   처리결과   {{김도윤}}   완료\n",
    "본 건은 서울특별시 소재 국세청 관할 사항으로 확인됨\n",
    "협조자: {{서인천지사}}\n",
    "성명: {{남궁민}}\n",
]


def test_published_accuracy(spark):
    """Names 14 right of 15 found and 17 marked, addresses 4 of 4 and 4."""
    cases = spark.createDataFrame(list(enumerate(CORPUS)), "case_id long, marked_text string")
    got = {r.type: (r.hits, r.predicted, r.gold) for r in evaluate.accuracy(cases).collect()}
    assert got == {"이름": (14, 15, 17), "주소": (4, 4, 4)}
    assert sorted(r.value for r in evaluate.misses(cases).collect()) == ["김도윤", "박민수", "서인천지사"]
