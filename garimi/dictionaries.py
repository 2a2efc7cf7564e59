"""Word lists, labels and enumerations that decide what is found."""

from __future__ import annotations

# Surnames; those of two syllables come last.
SURNAMES = (
    "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 전 홍 유 고 문 양 손 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 "
    "석 선 설 마 길 연 위 표 명 기 반 라 왕 금 옥 육 인 맹 제 모 류 나 탁 국 어 은 편 남궁 황보 제갈 선우 사공 서문"
).split()
# Words that are never a name.
EXCLUDE_WORDS = (
    "감사팀 감사실 총무팀 총무과 기획팀 기획과 인사팀 인사과 전산팀 전산실 회계팀 회계과 민원팀 민원실 지원팀 관리팀 운영팀 사업팀 국민은행 신한은행 우리은행 하나은행 농협은행 기업은행 카카오뱅크 "
    "케이뱅크 새마을금고 신협 우체국 팀장 과장 부장 차장 사원 주임 대리 이사 본부장 국장 실장 계장 반장 담당자 신청인 수령인 민원인 작성자 기안자 검토자 결재자 협조자 예금주"
).split()
# Provinces and metropolitan cities, long names first.
REGIONS = (
    "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 충청북도 충청남도 전북특별자치도 전라남도 경상북도 경상남도 제주특별자치도 "
    "서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주"
).split()
# Labels and titles that stand before a name.
NAME_LABELS = ["성명", "신청인", "수령인", "예금주", "담당", "민원인", "가입자"]
BUSINESS_LABELS = ["기안자", "검토자", "결재자", "협조자", "작성자", "기안", "검토", "결재", "협조"]
BUSINESS_TITLES = ["팀장", "과장", "차장", "부장", "국장", "실장", "본부장", "이사", "계장", "반장", "주임", "대리", "사원", "감사관", "위원"]
ADDRESS_LABELS = ["주소", "거주지"]
PHONE_CONTEXT_LABELS = ["발신자", "연락처"]
REPEATED_NAME_LABEL = "성명"
ACCOUNT_CONTEXT = ["계좌", "입금", "예금주"]
CARD_CONTEXT = ["카드"]
# Further labels that anchor a document's layout.
LAYOUT_LABELS = ["전화번호", "연락처", "발신자", "계좌", "입금", "카드", "이메일", "주민등록번호", "여권번호"]

# Enumerations.
NAME, PHONE, EMAIL, ACCOUNT, CARD, RRN, PASSPORT, ADDRESS, OTHER = "이름", "전화번호", "이메일", "계좌번호", "카드번호", "주민등록번호", "여권번호", "주소", "기타"
TYPES = [NAME, PHONE, EMAIL, ACCOUNT, CARD, RRN, PASSPORT, ADDRESS]
CONFIDENCE = ["낮음", "중간", "높음"]
GROUP_BASIC, GROUP_BUSINESS, GROUP_CROSS, GROUP_TEMPLATE, GROUP_MANUAL, GROUP_SAME_VALUE, GROUP_HINT = "기본", "업무상성명후보", "교차검증후보", "템플릿후보", "수동추가", "동일값추가", "후보힌트"
SOURCE_AUTO, SOURCE_MANUAL, SOURCE_HINT = "자동", "수동", "힌트"
DOCUMENT_TYPES = ["지출결의서", "출장", "민원", "계약", "기타"]
FOLDERS = {"originals": "원본_보관", "masked": "마스킹완료", "reports": "요약리포트", "logs": "로그"}
PROCESSED_MARKER = "MaskingTool-Processed:true"
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
# Reason for a failed conversion, by what its message holds, in order.
FAILURE_REASONS = {
    "매크로 보안 경고로 자동화가 차단됨": ["macro", "매크로", "보안"],
    "비밀번호로 잠긴 파일": ["password", "암호"],
    "한/글이 이미 다른 작업으로 사용 중": ["already", "in use", "다른 프로그램"],
    "손상되었거나 지원하지 않는 파일 형식": ["invalid", "corrupt", "형식"],
}
UNKNOWN_FAILURE = "변환 실패 (원인 미분류, 로그 확인 필요): "
# Learning from reviewers.
PROMOTE_AT, RECENT_DAYS, RECENT_LIMIT = 3, 7, 5
EXCLUDE_DIRECTION, NAME_DIRECTION = "제외", "이름후보"
# Layout matching.
GRID, MATCH_AT, MIN_SHARED, NEAR = 0.03, 0.6, 2, 1
