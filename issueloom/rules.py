"""Word lists, lookup tables and constants the results depend on."""

from html.entities import name2codepoint

# ---------------------------------------------------------------------------
# Fixed values. They decide results, so they are stated as they are.
# ---------------------------------------------------------------------------

CATEGORY_RULES = [
    ("정치/정책", [
        "정치", "대통령", "국회", "정부", "정책", "브리핑", "보도자료", "연설문", "국무회의", "위원회", "장관",
        "청와대", "대통령실", "국무조정실", "고용노동부", "과학기술정보통신부", "교육부", "국가보훈부", "국방부",
        "국토교통부", "기획예산처", "농림축산식품부", "문화체육관광부", "법무부", "법제처", "보건복지부", "산업통상부",
        "성평등가족부", "식품의약품안전처", "외교부", "인사혁신처", "재정경제부", "중소벤처기업부", "통일부",
        "해양수산부", "행정안전부", "경찰청", "검찰청", "국세청", "기상청", "소방청", "질병관리청", "검찰", "특검",
        "선거", "재선거", "대선", "총선", "지선", "보궐선거", "여당", "야당", "국민의힘", "민주당", "개혁신당",
        "조국혁신당", "의원", "원내대표", "당대표", "후보", "공천", "탄핵", "청문회", "국정조사", "법안", "개헌"]),
    ("문화/연예", [
        "연예", "문화", "영화", "음악", "방송", "드라마", "ott", "웹툰", "콘텐츠", "공연", "전시", "k-culture",
        "entertainment"]),
    ("스포츠", [
        "스포츠", "야구", "축구", "농구", "배구", "골프", "e스포츠", "격투기", "kbo", "lck", "월드컵", "프리미어리그",
        "올림픽"]),
    ("경제/산업", [
        "경제", "금융", "산업", "기업", "증시", "코스피", "코스닥", "환율", "금리", "물가", "투자", "부동산", "무역",
        "수출", "반도체", "자동차", "은행", "보험", "시장"]),
    ("IT/과학", [
        "it", "과학", "바이오", "ai", "인공지능", "기술", "데이터", "플랫폼", "보안", "모바일", "게임", "로봇", "우주",
        "엔비디아", "소프트웨어"]),
    ("국제", [
        "국제", "외교", "통일", "북한", "미국", "중국", "일본", "러시아", "유럽", "중동", "트럼프", "시진핑",
        "젤렌스키", "world"]),
    ("생활/건강", [
        "생활", "건강", "의료", "보건", "복지", "질병", "식품", "여행", "날씨", "환경", "기후", "교육", "노동", "고용"]),
    ("지역", [
        "지역", "지방", "수도권", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북",
        "충남", "전북", "전남", "경북", "경남", "제주"]),
    ("사회", [
        "사회", "사건", "사고", "경찰", "소방", "법원", "재판", "범죄", "안전", "교통", "시민", "노조", "집회", "수사",
        "고발", "피의자", "구속", "압수수색", "공판", "선고", "혐의", "소송"]),
]
DEFAULT_CATEGORY = "사회"
PHOTO_SECTION = "et포토"
PHOTO_CATEGORY = "문화/연예"
UNCATEGORISED = "미분류"
KNOWN_CATEGORIES = ["정치/정책", "경제/산업", "사회", "국제", "IT/과학", "문화/연예", "스포츠", "생활/건강", "지역"]

LOW_VALUE_WORDS = ["et포토", "포토", "화보"]

STOPWORDS = [
    "기자", "뉴스", "사진", "영상", "제공", "출처", "관련", "이번", "지난", "오는", "오늘", "내일", "어제",
    "오전", "오후", "이날", "최근", "현재", "대한", "통해", "위해", "대해", "따라", "등을", "등의",
    "있다", "했다", "한다", "됐다", "밝혔다", "말했다", "전했다", "설명했다", "나타났다", "것으로",
    "가운데", "그리고", "그러나", "하지만", "또는", "면서", "에서", "으로", "에게", "까지", "부터",
    "본문", "광고", "무단", "전재", "재배포", "금지", "copyright", "your", "browser", "support", "audio", "element",
]
ROLLUP_STOPWORDS = [
    "속보", "단독", "종합", "등록", "수정", "서울", "뉴시스", "연합뉴스", "한겨레", "경향신문", "동아일보",
    "위원장", "위원회", "대표", "정부", "대통령", "국민", "한국", "지원", "확대", "강화", "시작", "개최",
    "진행", "발표", "추진", "계획", "참석", "자료", "브리핑", "분야", "사업", "대상", "지역", "회의",
    "포토", "현장", "관계자", "오른쪽", "왼쪽", "모습", "있는", "없는", "합니다", "했습니다", "됩니다",
    "기사를", "읽어드립니다", "이미지", "무단전재", "재판매", "금지", "email", "protected", "newsis",
    "yonhap", "yna", "com", "www", "co", "kr", "ai", "협력", "위한", "함께", "국내", "해외", "미국",
    "중국", "일본", "올해", "전년", "대비", "기준", "보다", "따르면", "시장", "주요", "최대", "최소",
    "달러", "운영", "있도록", "자료제공", "바랍니다", "자세한", "결정된", "실무", "korea", "north",
    "south", "공감언론", "계획이다", "오른", "내린", "증가했다", "감소했다", "동기", "포인트", "결과",
    "통합", "구성", "방안", "문제", "사용", "가능", "확인", "사람", "시민", "공개", "전국", "부산",
    "부산시", "광주", "전남", "전북", "경남", "경북", "충남", "충북", "강원", "제주", "대구", "대전",
    "울산", "인천", "경기", "수도권",
]
REPORTER_SUFFIX = "기자"
COUNTED_UNIT_PATTERN = r"^\d+(년|월|일|시|분|초|명|건|개|곳|차|위|호|회|명)$"
TOKEN_PATTERN = "[a-z0-9가-힣]{2,}"

# A topic holds when any subject word and any event word occur.
TOPIC_RULES = [
    ("vote_issue",
     ["투표용지", "투표지", "투표소", "개표소", "선관위", "참정권"],
     ["부족", "사태", "재선거", "봉쇄", "잠실", "송파", "검경", "법원", "수사", "증거보전"]),
]

# host part, publisher, guide page; the first part contained in the host wins
PUBLISHER_RULES = [
    ("yna.co.kr", "연합뉴스", "https://www.yna.co.kr/rss/index"),
    ("yonhapnewstv.co.kr", "연합뉴스TV", "https://www.yonhapnewstv.co.kr/browse/feed/"),
    ("newsis.com", "뉴시스", "https://www.newsis.com/RSS/"),
    ("hankyung.com", "한국경제", "https://www.hankyung.com/feed"),
    ("mk.co.kr", "매일경제", "https://www.mk.co.kr/rss/"),
    ("etnews.com", "전자신문", "https://rss.etnews.com/"),
    ("donga.com", "동아일보", "https://rss.donga.com/"),
    ("hani.co.kr", "한겨레", "https://www.hani.co.kr/rss/"),
    ("khan.co.kr", "경향신문", "https://www.khan.co.kr/help/help_rss.html"),
    ("news.sbs.co.kr", "SBS 뉴스", "https://news.sbs.co.kr/news/rss.do"),
    ("korea.kr", "정책브리핑", "https://www.korea.kr/etc/rss.do"),
    ("imbc.com", "MBC 뉴스", None),
    ("jtbc.co.kr", "JTBC 뉴스", "https://news.jtbc.co.kr/rss"),
    ("bbc.com", "BBC", "https://www.bbc.com/news/10628494"),
    ("bbci.co.uk", "BBC", "https://www.bbc.com/news/10628494"),
]
UNKNOWN_PUBLISHER = "알 수 없음"

SHORT_SOURCE_RULES = [
    ("gonggam.korea.kr", "공감"),
    ("newsis.com", "뉴시스"),
    ("news.sbs.co.kr", "SBS 뉴스"),
    ("imbc.com", "MBC 뉴스"),
    ("news.jtbc.co.kr", "JTBC 뉴스"),
    ("korea.kr", "정책브리핑"),
    ("etnews.com", "전자신문"),
    ("yna.co.kr", "연합뉴스"),
    ("hani.co.kr", "한겨레"),
    ("bbc.com", "BBC"),
]
GENERIC_SOURCES = [
    "포토", "속보", "전체", "뉴스", "사회", "경제", "정치", "국제", "문화", "스포츠", "산업", "금융", "광장",
    "IT·바이오",
]
NO_SOURCE = "출처"

# Page parts that never hold article text, and the containers that do.
NOISE_TAGS = ["script", "style", "noscript", "iframe", "nav", "aside", "footer", "header", "form", "button"]
BODY_CLASSES = [
    "article-body", "articleBody", "news_view", "news-view", "view_cont", "view-content", "article_view",
    "article-content", "article_txt", "article-text", "news_text", "news-content",
]
BODY_IDS = [
    "articleBody", "article_body", "news_body_area", "dic_area", "articeBody", "article-view-content-div",
]
MIN_PARAGRAPH = 40
MAX_BODY = 12000
MIN_BODY_FLOOR = 80
MIN_BODY_DEFAULT = 220

FETCH_BAD_URL = "기사 링크 형식이 올바르지 않아 본문을 가져오지 못했습니다."
FETCH_UNSAFE = "기사 링크가 안전하지 않은 주소를 가리켜 본문을 가져오지 못했습니다."
FETCH_TOO_SHORT = "기사 본문 영역을 충분히 찾지 못했습니다. RSS 요약으로 대체합니다."

VECTOR_SIZE = 128
HASHES_PER_TOKEN = 4
GROUP_THRESHOLD = 0.78

# ---------------------------------------------------------------------------
# Derived: the HTML 4 character entities plus `apos`.
# ---------------------------------------------------------------------------
HTML_ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}

# (code, level, text) of the warnings about the state of the stores, in the order they are listed
WARNINGS = [
    ("rss_feed_empty", "error", "등록된 RSS 피드가 없습니다."),
    ("article_empty", "warning", "저장된 뉴스 기사가 없습니다."),
    ("article_update_stale", "warning", "최근 기사 갱신이 {stale_article_hours}시간 이상 지연되었습니다."),
    ("summary_empty", "warning", "저장된 전날/주간 요약이 없습니다."),
    ("summary_stale", "warning", "최근 요약 생성이 {stale_summary_hours}시간 이상 지연되었습니다."),
    ("pipeline_failed", "error", "마지막 뉴스 수집 파이프라인이 실패했습니다."),
    ("pipeline_long_running", "warning", "뉴스 수집 파이프라인이 {long_run_minutes}분 이상 실행 중입니다."),
    ("content_fetch_failure_rate_high", "warning", "본문 수집 실패율이 {{percent}}입니다."),
    ("duplicate_article_rate_high", "info", "중복으로 판단되는 기사 비율이 {{percent}}입니다."),
]
