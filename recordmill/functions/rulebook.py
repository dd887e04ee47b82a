"""Audit rules as data. Patterns are Java regular expressions."""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column

from recordmill.functions.text import SPACE as S

# Names, lists and patterns that decide what counts as an issue.

PAIRS = (("‘", "’", "작은따옴표"), ("“", "”", "큰따옴표"), ("(", ")", "소괄호"), ("[", "]", "대괄호"), ("「", "」", "낫표"), ("『", "』", "겹낫표"), ("〈", "〉", "홑화살괄호"), ("《", "》", "겹화살괄호"))

INSTITUTIONS = (
    "유엔", "국제연합", "세계보건기구", "세계무역기구", "국제통화기금", "유네스코", "유니세프", "나토", "국제원자력기구", "세계기상기구", "국제노동기구", "세계식량계획", "국제앰네스티", "앰네스티", "그린피스", "국경없는의사회", "국경 없는 의사회", "적십자", "대한적십자사", "세계자연기금", "국제방사선방호위원회", "세계원자력발전사업자협회", "통계청", "경찰청", "검찰청", "국세청", "관세청", "기상청", "산림청", "특허청", "수사청", "질병관리청", "식품의약품안전처", "식약처", "환경부", "보건복지부", "과학기술정보통신부", "국토교통부", "고용노동부", "여성가족부", "문화체육관광부", "행정안전부", "기획재정부", "농림축산식품부", "산업통상자원부", "해양수산부", "중소벤처기업부", "국립국어원", "국가인권위원회", "헌법재판소", "국민건강보험공단", "국민연금공단", "한국은행", "한국전력공사", "한국철도공사", "코레일", "한국소비자원", "한국관광공사", "한국장학재단", "한국교육과정평가원", "한국과학창의재단", "한국연구재단", "한국과학기술원", "한국음악저작권협회", "한국음악저작권 협회", "한국전통문화전당", "종로경찰서", "독립협회", "미국심장학회", "식품안전나라", "나눔의 집", "나눔의집", "달빛어린이병원", "KBS 방송국", "아마존협력조약기구", "아마존 협력 조약기구", "산남고", "산남중", "산남초", "서울대", "연세대", "고려대", "성균관대", "한양대", "중앙대", "경희대", "서강대", "이화여대", "건국대", "동국대", "홍익대", "국민대", "숭실대", "세종대", "단국대", "아주대", "인하대", "부산대", "경북대", "전남대", "전북대", "충남대", "충북대", "강원대", "제주대", "카이스트", "포스텍", "유니스트", "지스트", "하버드", "스탠퍼드", "스탠포드", "옥스퍼드", "케임브리지", "프린스턴", "도쿄대", "칭화대",
)
INSTITUTION_ACRONYMS = ("UN", "WHO", "WTO", "IMF", "OECD", "OECE", "EU", "UNESCO", "UNICEF", "NATO", "NASA", "IAEA", "ILO", "FAO", "WFP", "WMO", "IPCC", "UNHCR", "UNDP", "UNEP", "ASEAN", "APEC", "OPEC", "WWF", "CDC", "FDA", "EPA", "NGO", "KBS", "MBC", "SBS", "EBS", "MIT", "KAIST", "POSTECH", "UNIST", "GIST", "DGIST", "ODA")
BUSINESSES = (
    "삼성", "삼성전자", "삼성그룹", "현대자동차", "현대그룹", "포스코", "한화", "두산", "신세계", "이마트", "롯데월드", "롯데마트", "네이버", "카카오", "카카오톡", "카카오페이", "카카오뱅크", "카카오 헬스케어", "카카오헬스케어", "쿠팡", "배달의민족", "당근마켓", "구글", "애플", "아마존", "마이크로소프트", "테슬라", "엔비디아", "인텔", "퀄컴", "화웨이", "샤오미", "소니", "도요타", "토요타", "필립스", "스페이스X", "유튜브", "넷플릭스", "인스타그램", "페이스북", "틱톡", "스레드", "디즈니", "픽사", "지브리", "나이키", "아디다스", "유니클로", "스타벅스", "맥도날드", "버거킹", "코카콜라", "다이소", "올리브영", "세븐일레븐", "프라다", "세라젬", "한강 버거", "챗GPT", "오픈AI", "딥마인드", "제미나이", "파파고",
)
BUSINESS_ACRONYMS = ("SpaceX", "ChatGPT", "OpenAI", "DeepMind", "Threads", "NVIDIA", "VIPKID", "LG", "SK", "CJ", "GS25", "AMD")
ALLOWED = ("대한민국학술원", "국사편찬위원회", "국립국제교육원", "국립특수교육원", "교원소청심사위원회", "중앙교육연수원")

STOP = rf"(?:$|[{S[1:-1]},.;:!?·→←\-)]|[\"'’])"
HEAD = r"(?<![가-힣A-Za-z0-9])"
TAIL = rf"(?={STOP}|(?:에서|에게|으로|의|과|와|은|는|이|가|을|를|도|만|에|로){STOP})"
BOUND, UNBOUND = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
GAP = "[^.!?]{0,24}"
EXAM, MARK = "(?:모의고사|전국연합학력평가)", "(?:성적|점수|등급|석차|백분위|표준점수)"
RANGE = rf"(20\d{{2}}){S}*\.{S}*(\d{{1,2}}){S}*\.{S}*(\d{{1,2}}){S}*\.?{S}*[-~〜∼]{S}*(20\d{{2}}){S}*\.{S}*(\d{{1,2}}){S}*\.{S}*(\d{{1,2}}){S}*\.?"
SYMBOLS = "[①-⑳㉠-㉻⑴-⒇ⓐ-ⓩ●○■□◆◇▲△▼▽★☆▶▷◀◁※§¶♣♠♥♦♤♡◎→←↑↓⇒⇔↔✓✔✗✘☎☏☞☜♬♪♩†‡"
#: Pictographs, spelled out as ranges.
SYMBOLS += "©®‼⁉™ℹ↖-↙↩↪⌚⌛⌨⎈⏏⏩-⏳⏸-⏺Ⓜ▪▫◻-◾☀-★☇-☒☔-♯♲-⚅⚐-✅✈-✒✖✝✡✨✳✴❄❇❌❎❓-❕❗❣-❧➕-➗➡➰➿⤴⤵⬅-⬇⬛⬜⭐⭕〰〽㊗㊙\\x{1F000}-\\x{1F0FF}\\x{1F10D}-\\x{1F10F}\\x{1F12F}\\x{1F16C}-\\x{1F171}\\x{1F17E}\\x{1F17F}\\x{1F18E}\\x{1F191}-\\x{1F19A}\\x{1F1AD}-\\x{1F1E5}\\x{1F201}-\\x{1F20F}\\x{1F21A}\\x{1F22F}\\x{1F232}-\\x{1F23A}\\x{1F23C}-\\x{1F23F}\\x{1F249}-\\x{1F3FA}\\x{1F400}-\\x{1F53D}\\x{1F546}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F774}-\\x{1F77F}\\x{1F7D5}-\\x{1F7FF}\\x{1F80C}-\\x{1F80F}\\x{1F848}-\\x{1F84F}\\x{1F85A}-\\x{1F85F}\\x{1F888}-\\x{1F88F}\\x{1F8AE}-\\x{1F8FF}\\x{1F90C}-\\x{1F93A}\\x{1F93C}-\\x{1F945}\\x{1F947}-\\x{1FAFF}\\x{1FC00}-\\x{1FFFD}]"


#: Words of offices, the clubs whose terms aren't looked at, and words that tell a council's terms and a class's.
OFFICES = ("임원", "회장", "부회장", "자치회", "전교", "실장", "반장", "부장", "차장")
CLUB, COUNCIL, ROOM = "동아리", ("자치회", "전교"), ("학급", "실장", "반장")


@dataclasses.dataclass(frozen=True)
class Rule:
    type: str
    label: str
    pattern: str
    severity: str = "warning"
    reference: str = "문장 형식 점검"
    #: What a reviewer is told, in our own words.
    guidance: str = ""
    #: Names a rule that no pattern finds.
    name: str = ""
    #: Texts of which every match holds one: looked for first, which costs little.
    needs: tuple[str, ...] = ()

    def may_match(self, text: Column) -> Column:
        """Whether a text holds what every match needs."""
        return reduce(lambda a, b: a | b, [text.contains(n) for n in self.needs])

    def hits(self, text: Column) -> Column:
        """Whether a text has a match."""
        found = text.rlike(self.pattern)
        return self.may_match(text) & found if self.needs else found


def any_of(names: tuple[str, ...]) -> str:
    """A pattern of a trie of names: each character is tried once, however many names begin with it. At every branch longer
    names come first, so a name doesn't hide one that it begins; a look at the first character spares most tries."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = [re.escape(c).replace(r"\ ", " ") + branch(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        return (f"(?:{'|'.join(parts)})" if len(parts) > 1 or "" in node else parts[0]) + ("?" if "" in node else "")

    return f"(?=[{''.join(sorted(map(re.escape, tree)))}]){branch(tree)}"


def entity(body: str, cased: bool = False) -> str:
    return ("" if cased else "(?iu)") + f"{HEAD}(?:{body}){TAIL}"


TYPOS = (
    Rule("typo", "문장 띄어쓰기", "[.!?](?=[가-힣A-Za-z])", guidance="문장부호 뒤를 띄어 씁니다."),
    Rule("typo", "문장부호 반복", r"([.,!?])\1+", guidance="문장부호가 거듭 쓰였습니다."),
    Rule("typo", "단어 반복", rf"(?iu)(^|{S})([가-힣A-Za-z]{{2,}}){S}+\2(?={S}|[.,!?]|$)", guidance="낱말이 거듭 쓰였습니다."),
    Rule("typo", "맞춤법 의심", rf"역활|됬|되여|어떻해|왠만|몇일|갯수|촛점|왠일|웬지|오랫만|희안|곰곰히|일일히|틈틈히|뿐만아니라|해박과|할수(?={S}|[.,!?]|$)", reference="맞춤법 보조 점검", guidance="흔한 맞춤법 오류인지 살핍니다.", needs=tuple("역활|됬|되여|어떻해|왠만|몇일|갯수|촛점|왠일|웬지|오랫만|희안|곰곰히|일일히|틈틈히|뿐만아니라|해박과|할수".split("|"))),
    Rule("typo", "따옴표 오입력", "[｀`´＇＂′″‵‛‟〝〞〃]", guidance="따옴표와 닮은 기호입니다."),
    Rule("typo", "명사형 종결", rf"(?:[가-힣]다|습니다|입니다|[아어여해]요)(?={S}*[.!?])", reference="2026 기재요령 p.30 · 현장점검 3-⑤", guidance="문장을 명사형으로 끝맺습니다.", needs=("다", "요")),
    Rule("typo", "따옴표 모양", "[‘’“”]", reference="학교 점검 중점사항 ⑩", guidance="곧은따옴표를 씁니다."),
)
PROHIBITED = (
    Rule("prohibited", "공인어학시험", rf"(?iu){BOUND}(?:TOEIC|TOEFL|TEPS|HSK|JPT|JLPT|DELF|DALF|TESTDAF|DSH|DSD|TORFL|DELE|ZD){UNBOUND}|토익|토플|텝스|공인어학시험|한자능력검정|한자자격검정|상공회의소한자|실용한자|한자급수자격검정|한자급수인증시험|YBM{S}*상무{S}*한검", "danger", "2026 기재요령 p.18", "어학시험 이름이나 점수로 보이는 말은 빼야 합니다."),
    Rule("prohibited", "대회·수상", rf"대회|(?:최우수|우수|장려|공로)상(?={STOP}|(?:을|를|은|는|이|가|에|과|와|도|만|의|으로|로)(?![가-힣]))|표창장|감사장|수상{S}*(?:실적|사실)|입상", "danger", "2026 기재요령 p.18, p.61 · 학교 점검 중점사항 ②", "대회 이름이나 상을 받은 일로 읽히는 말은 이 칸에 쓰지 않습니다.", needs=("대회", "상", "표창장", "감사장")),
    Rule("prohibited", "시험·성적", rf"인증{S}*시험|{EXAM}{GAP}{MARK}|{MARK}{GAP}{EXAM}|(?:원점수|석차){S}*\d*", "danger", "2026 기재요령 p.18", "시험 점수나 등급을 알 수 있는 말은 지웁니다.", needs=("인증", "모의고사", "전국연합학력평가", "원점수", "석차")),
    Rule("prohibited", "도서 출간", rf"(?iu)도서{S}*(?:출간|출판)|출판{S}*사실|ISBN{S}*(?:등록|등재)", "danger", "2026 기재요령 p.18", "책을 펴낸 일은 적지 않습니다."),
    Rule("prohibited", "지식재산권", rf"(?:특허|실용신안){S}*권?[을를]?{S}*(?:출원|등록|취득)|상표{S}*(?:출원|등록)|디자인{S}*(?:출원|등록)", "danger", "2026 기재요령 p.18", "특허나 상표 따위를 낸 일은 적지 않습니다.", needs=("특허", "실용신안", "상표", "디자인")),
    Rule("prohibited", "해외 활동", rf"해외{S}*(?:어학연수|봉사활동|연수|캠프)|어학연수", "danger", "2026 기재요령 p.18", "나라 밖에서 한 활동은 적지 않습니다.", needs=("해외", "어학연수")),
    Rule("prohibited", "논문 등재", rf"논문{S}*(?:등재|게재|투고)|학술지{S}*(?:등재|게재|투고)|학회{S}*(?:에서)?{S}*발표", "danger", "2026 기재요령 p.18 · 학교 점검 중점사항 ⑧", "논문을 내거나 학회에서 알린 일은 적지 않습니다.", needs=("논문", "학술지", "학회")),
    Rule("prohibited", "세특 입력 불가", rf"(?iu){BOUND}(?:K[-‐]?MOOC|MOOC|KOCW){UNBOUND}|소{S}*논문", "danger", "2026 기재요령 p.118, p.149", "온라인 강좌와 작은 논문은 이 칸에 적지 않습니다."),
    Rule("prohibited", "방과후학교", rf"방과{S}*후{S}*학교", "warning", "2026 기재요령 p.118, p.159", "수업 뒤 학교 과정은 다른 칸에 적습니다.", needs=("방과",)),
    Rule("prohibited", "장학 관련", rf"장학생|장학금|장학{S}*수혜", "danger", "2026 기재요령 p.18", "장학금에 얽힌 일은 적지 않습니다.", needs=("장학",)),
    Rule("prohibited", "자격증", rf"(?iu)자격증|자격{S}*(?:취득|획득)|국가직무능력표준|NCS{S}*이수", "danger", "2026 기재요령 p.19", "자격을 딴 일은 정해진 칸에만 적습니다."),
)
_INSTITUTION = "실제 기관이나 학교 이름이면 예외 목록에 있는지 찾아봅니다."
_BUSINESS = "실제 회사나 상품 이름이면 다른 말로 바꿉니다."
_NAMED = "2026 기재요령 p.19 · 교사 점검대장 사례"
SYMBOL = (Rule("symbol", "특수기호", r"(?![\x00-\x7F가-힣])" + SYMBOLS, reference="2026 기재요령 p.30", guidance="자판에 없는 기호는 글로 풀어 씁니다."),)
_KINDS = "연구원|연구소|학회|협회|재단|방송국|신문사|병원|박물관|미술관|도서관|공단|공사|위원회|전당"
ENTITIES = (
    Rule("institution", "기관명", entity(any_of(INSTITUTIONS)), reference=_NAMED, guidance=_INSTITUTION),
    Rule("institution", "기관명", entity(any_of(INSTITUTION_ACRONYMS), True), reference=_NAMED, guidance=_INSTITUTION),
    Rule("institution", "기관명", entity("[가-힣A-Za-z0-9·]{2,24}(?:대학교|전문대학|사관학교|고등학교|중학교|초등학교)"), reference=_NAMED, guidance=_INSTITUTION, needs=("대학교", "전문대학", "사관학교", "고등학교", "중학교", "초등학교")),
    Rule("institution", "기관명", entity("(?:한국|대한|국립|국제|세계|미국|서울|충북|청주|산남|[A-Z]{2,})[가-힣A-Za-z0-9·]{1,20}(?:" + _KINDS + ")"), reference=_NAMED, guidance=_INSTITUTION, needs=tuple(_KINDS.split("|"))),
    Rule("institution", "기관명", entity("[가-힣]{2,12}(?:공항|경찰서)"), reference=_NAMED, guidance=_INSTITUTION, needs=("공항", "경찰서")),
    Rule("institution", "학교 추측", entity(rf"다산(?!{S}*정약용)|산동(?!성|반도)|산국"), reference="학교 점검 중점사항 ①", guidance="어느 학교인지 짐작하게 하는 말인지 앞뒤를 읽어 봅니다.", needs=("다산", "산동", "산국")),
    Rule("business", "상호명", entity(rf"(?:주식회사|\(주\)|㈜){S}*[가-힣A-Za-z0-9·]+|{any_of(BUSINESSES)}"), reference=_NAMED, guidance=_BUSINESS),
    Rule("business", "상호명", entity(any_of(BUSINESS_ACRONYMS), True), reference=_NAMED, guidance=_BUSINESS),
)
#: A trigger that is an issue unless a phrase stands anywhere in the text.
ABSENCE = ("헌혈", rf"대한적십자사{S}*충북혈액원")
RULES = TYPOS + PROHIBITED + SYMBOL + ENTITIES
CAP = 10

_LONE = "짝을 이루는 부호가 빠졌는지 살핍니다."
MARKS = tuple(Rule("typo", "짝 안 맞는 부호", "", guidance=f"{name}: {_LONE}", name=f"mark {i}") for i, name in enumerate([n for _, _, n in PAIRS] + ["곧은 작은따옴표", "곧은 큰따옴표"]))
_OFFICE = "학교 점검 중점사항 ⑨"
PERIODS = (
    Rule("typo", "임원 기간", "", "danger", _OFFICE, "달력에 없는 날입니다.", "term date"),
    Rule("typo", "임원 기간", "", "danger", _OFFICE, "기간이 시작하기 전에 끝납니다.", "term order"),
    Rule("typo", "임원 기간", "", "warning", _OFFICE, "자치회 임기는 첫 학기에 8월 10일에 끝납니다.", "term council"),
    Rule("typo", "임원 기간", "", "warning", _OFFICE, "학급 임기는 첫 학기에 8월 31일에 끝납니다.", "term class"),
    Rule("typo", "임원 기간", "", "danger", _OFFICE, "학년과 연도가 다른 임기와 맞지 않습니다.", "term year"),
)
ABSENT = Rule("institution", "헌혈 기관명", "", reference="학교 점검 중점사항 ④", guidance="헌혈을 한 기관의 정식 이름이 없습니다.", name="absence")
OVERFLOW = Rule("typo", "분량 초과", "", reference="나이스 입력 한도 대조", guidance="여기부터는 입력할 수 있는 길이를 넘으니 다른 글이 붙었는지 봅니다.", name="overflow")
#: All rules in the order in which hits of one place are listed.
ORDERED = (*TYPOS, *MARKS, *PERIODS, *PROHIBITED, *SYMBOL, *[r for r in ENTITIES if r.type == "institution"], ABSENT, *[r for r in ENTITIES if r.type == "business"], OVERFLOW)
