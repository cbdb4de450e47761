"""Values of personal information, and what only looks like them, made at random for training.

The labels of most training spans come from here: a value is drawn from these rules and put into a
text, so where it begins and ends is known without looking for it."""

from __future__ import annotations

import numpy as np

# Common Korean family names of one syllable and of two.
FAMILY = "김이박최정강조윤장임한오서신권황안송전홍문배유류고양손백허남심노하곽성차주우구민진지엄채원천방공현함변여추도소석선설마길위표명기반왕금옥육인맹제모탁국"
FAMILY_TWO = "남궁 선우 제갈 독고 황보 사공 서문 동방".split()
# Korean family names in Latin letters; given and family names of other languages.
LATIN_FAMILY = "Kim Lee Park Choi Jung Jeong Kang Cho Yoon Jang Lim Han Oh Seo Shin Kwon Hwang Ahn Song Jeon Hong Moon Bae Yoo Nam Yang Ko Son Baek Heo Noh Ha Min Jin".split()
OTHER_GIVEN = "James Mary John Anna David Laura Peter Susan Paul Helen Mark Alice Thomas Julia Daniel Sarah Robert Nina Michael Olivia George Clara Henry Sophie Lucas Marta Ivan Elena Carlos Rosa Omar Aisha Kenji Yuki Wei Mei Raj Priya Linh Minh".split()
OTHER_FAMILY = "Smith Jones Taylor Wilson Moore Clark Walker Young Allen Wright Scott Green Baker Adams Nelson Carter Turner Parker Evans Collins Cooper Reed Cook Morgan Bell Murphy Bailey Ward Cox Gray Silva Garcia Rossi Weber Novak Tanaka Sato Chen Nguyen Singh".split()
# Letters for making syllables in Latin script and parts of made-up names of places.
_ONSET = "b c d f g h j k l m n p r s t v w y ch sh th br gr st".split()
_RHYME = "a e i o u ae eo eu an en in on un ang ong el ar or".split()
TITLES = "씨 씨는 씨가 기자 기자는 주무관은 위원장 센터장은 반장 감독 대표 작가 연구원은 의원은 팀장 변호사 농민은 교장 학부모가 과장은 이장 드림 선생님 교수는 선수 학생 님 군 양 올림 배상 시장은 간호사는 소방장은".split()

_DASHES = "--- -–‐－.·"
_WIDE = str.maketrans("0123456789-", "０１２３４５６７８９－")
_SPOKEN = "공일이삼사오육칠팔구"


class Values:
    """A source of values; ``syllables`` are those of the corpus."""

    def __init__(self, rng: np.random.Generator, syllables: str) -> None:
        self.r, self.syllables = rng, syllables

    def one(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def coin(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def hangul(self, n: int) -> str:
        return "".join(self.one(self.syllables) for _ in range(n))

    def latin(self, n: int) -> str:
        return "".join(self.one(_ONSET) + self.one(_RHYME) for _ in range(n))

    def sep(self) -> str:
        s = self.one(_DASHES)
        return f" {s} " if self.coin(0.08) and s != " " else s

    def name(self) -> str:
        x = self.r.random()
        if x < 0.78:
            gap = " " if self.coin(0.08) else ""
            if self.coin(0.08):
                return self.one(FAMILY_TWO) + (" " if self.coin(0.5) else "") + self.hangul(1 + self.coin(0.8))
            family = self.one(FAMILY[:22]) if self.coin(0.7) else self.one(FAMILY)
            return family + gap + self.hangul(1 if self.coin(0.1) else 2)
        return self.latin_name()

    def latin_name(self) -> str:
        x = self.r.random()
        if x < 0.55:
            given = self.latin(1).capitalize() + self.one(["-"] * 8 + [""]) + self.latin(1)
            if self.coin(0.1):
                given = f"{self.latin(1).capitalize()} {self.latin(1).capitalize()}"
            family = self.one(LATIN_FAMILY)
            return f"{given} {family}" if self.coin(0.65) else f"{family} {given}"
        given = self.one(OTHER_GIVEN) if self.coin(0.6) else self.latin(2).capitalize()
        family = self.one(OTHER_FAMILY) if self.coin(0.6) else self.latin(2).capitalize()
        middle = f" {self.one('ABCDEFGHJKLMRST')}." if self.coin(0.08) else ""
        return f"{given}{middle} {family}"

    def email(self) -> str:
        local = self.latin(int(self.r.integers(1, 4)))
        if self.coin(0.45):
            local += self.one("._+-") + self.latin(int(self.r.integers(1, 3)))
        if self.coin(0.5):
            local += self.digits(int(self.r.integers(1, 5)))
        if self.coin(0.1):
            local = local.upper() if self.coin(0.5) else local.capitalize()
        host = [self.latin(int(self.r.integers(1, 4))) + ("-mail" if self.coin(0.15) else "")]
        if self.coin(0.4):
            host.insert(0, self.one(["mail", "post", "news", "web", self.latin(1)]))
        host.append(self.one(["example", "test", "invalid", "com", "net", "org", "kr", "co.kr", "go.kr"]))
        at = self.one(["@"] * 8 + [" @ ", "＠", " at ", " (at) ", "(at)", " [at] ", " 골뱅이 ", "골뱅이"])
        dot = " dot " if at in (" at ", " (at) ") and self.coin(0.5) else "."
        return local + at + dot.join(host)

    def phone(self) -> str:
        x = self.r.random()
        if x < 0.05:
            return self.one(["1588", "1577", "1644", "1600", "1899", "080"]) + self.sep() + self.digits(4)
        if x < 0.09:
            return self.one(["+1 ", "+1-", "+44 ", "+49 ", "+81-", "+86 "]) + self.digits(int(self.r.integers(2, 4))) + self.one("- ") + self.digits(3) + self.one("- ") + self.digits(4)
        mobile = self.coin(0.6)
        code = ("10" if self.coin(0.85) else self.one(["11", "16", "17", "18", "19"])) if mobile else self.one(["2", *(f"{a}{b}" for a in "3456" for b in "1234"), "70", "80"])
        middle = self.digits(4 if mobile or self.coin(0.2) else 3)
        end, s = self.digits(4), self.sep()
        if x < 0.15:
            spoken = lambda d: "".join(_SPOKEN[int(c)] for c in d)
            return self.one("-- ").join([spoken("0" + code), spoken(middle), spoken(end)])
        if x < 0.3:
            return self.one(["+82", "+82 ", "+82-", "(+82)", "(+82) ", "+82 (0)"]) + (f"({code})" if self.coin(0.1) else code) + s + middle + s + end
        if x < 0.4:
            return f"(0{code})" + self.one(["", " "]) + middle + self.one("-- ") + end
        if x < 0.46:
            return f"0{code})" + self.one(["", " "]) + middle + self.one("-- ") + end
        if x < 0.56:
            s = ""
        got = "0" + code + s + middle + s + end
        return got.translate(_WIDE) if self.coin(0.08) else got

    def id_number(self) -> str:
        x = self.r.random()
        if x < 0.65:
            day = self.digits(2) + f"{self.r.integers(1, 13):02d}{self.r.integers(1, 29):02d}"
            got = day + self.one(["-", "-", "-", "", " - ", "–", " "]) + str(self.r.integers(1, 9)) + self.digits(6)
        elif x < 0.85:
            letter = self.one("MSRODG")
            got = letter + (self.digits(3) + self.one("ABCDEFGHJKLMNPRST") + self.digits(4) if self.coin(0.6) else self.digits(8))
        else:
            s = self.one(["-", "-", " - ", "–"])
            got = s.join([self.digits(2), self.digits(2), self.digits(6), self.digits(2)])
        return got.translate(_WIDE) if self.coin(0.06) else got

    def town(self, ends: str) -> str:
        return self.hangul(2) + self.one(ends)

    def lot(self) -> str:
        n = self.digits(int(self.r.integers(1, 4))).lstrip("0") or "7"
        return n + ("-" + str(self.r.integers(1, 99)) if self.coin(0.35) else "")

    def address(self) -> str:
        if self.coin(0.14):
            road = f"{self.latin(2).capitalize()}-{self.one(['daero', 'ro', 'gil', 'ro'])}"
            got = [f"{self.lot()}, {road}" + (f" {self.r.integers(1, 60)}{self.one(['', 'beon'])}-gil" if self.coin(0.3) else "")]
            if self.coin(0.35):
                got.append(f"{self.latin(2).capitalize()}-{self.one(['ri', 'eup', 'myeon', 'dong', 'gu'])}")
            return ", ".join([*got, f"{self.latin(2).capitalize()}-{self.one(['si', 'gun', 'gu', 'do'])}"])
        got = []
        if self.coin(0.25):
            got.append(self.one([self.town("도"), self.hangul(2) + "특별시", self.hangul(2) + "광역시"]))
        if self.coin(0.85):
            got.append(self.town("시군구"))
        if self.coin(0.45):
            got.append(self.town("읍면동가"))
        n = self.lot()
        if self.coin(0.7):
            road = self.hangul(int(self.r.integers(1, 3))) + self.one(["로", "길", "대로", "로"])
            if self.coin(0.25):
                road += self.one(["", " "]) + f"{self.r.integers(1, 200)}{self.one(['번길', '길'])}"
            got.append(road + ("" if self.coin(0.05) else " ") + n + ("번지" if self.coin(0.05) else ""))
        else:
            got.append(self.hangul(2) + self.one("리동"))
            got.append(self.one(["", "", "산 ", "산"]) + n + self.one(["", "", "번지", " 번지"]))
        x = self.r.random()
        unit = self.one([", ", " ", ",  "[:2]])
        if x < 0.2:
            got[-1] += unit + (self.hangul(2) + self.one(["아파트 ", "빌라 ", "타워 "]) if self.coin(0.3) else "") + f"{self.r.integers(101, 130)}동 {self.r.integers(101, 2500)}호"
        elif x < 0.3:
            got[-1] += unit + self.one(["", "", "지하 "]) + f"{self.r.integers(1, 20)}층" + (f" {self.r.integers(101, 999)}호" if self.coin(0.4) else "")
        elif x < 0.36:
            got[-1] += unit + f"{self.r.integers(101, 999)}호"
        return " ".join(got)

    def of(self, kind: str) -> str:
        return getattr(self, kind)()

    def none(self) -> str:
        """A sentence with what looks like personal information and isn't."""
        d, h = self.digits, self.hangul
        return self.one([
            f"사업자 등록 {d(3)}-{d(2)}-{d(5)}로 조회됩니다.",
            f"사업자 번호 {d(3)}-{d(2)}-{d(5)} 업체입니다.",
            f"문서 번호 제20{d(2)}-{d(4)}호를 확인했습니다.",
            f"접수 번호 {d(4)}-{d(4)}, 계좌 {d(3)}-{d(6)}-{d(2)} 입니다.",
            f"A씨는 010-****-{d(2)} 번호만 남겼습니다.",
            f"연락처 010-{d(4)}-**** 또는 {d(6)}-*******로 가려져 있다.",
            f"{self.one(FAMILY[:20])}모 씨와 {self.one(FAMILY[:20])}○○ 씨는 익명을 원했다.",
            f"{self.one('ABCDEFG')}씨는 {h(2)}동에서 만난 이웃이다.",
            f"{h(2)}로 일대와 {h(2)}길 구간은 {self.r.integers(1, 13)}월 {self.r.integers(1, 29)}일 통제된다.",
            f"{h(2)}시 {h(2)}읍 주민 {d(3)}명이 찾았다.",
            f"{self.one(FAMILY[:20])}{h(2)} 아파트 앞에 모였다.",
            f"20{d(2)}.{self.r.integers(1, 13):02d}.{self.r.integers(1, 29):02d} {d(2)}:{d(2)} 입력, {d(4)}만 원, {d(1)}.{d(1)}%.",
            f"The {self.latin(2).capitalize()} {self.one(['Center', 'Festival', 'Library', 'Museum', 'Bridge', 'School'])} in {self.latin(2).capitalize()}-si drew {d(3)} people.",
            f"{self.latin(2).capitalize()} {self.one(['Daily', 'Times', 'News', 'Press', 'Post'])} All rights reserved. Order {d(4)}-{d(5)}.",
            f"{h(2)}@ 계정과 {self.latin(2)} 골뱅이무침 이야기다.",
        ])

    def sentence(self) -> list[tuple[str, str]]:
        """Parts (kind or '', text) of a made-up sentence with values in it."""
        v = lambda k: (k, self.of(k))
        t = lambda s: ("", s)
        return self.one([
            lambda: [t("제 이름은 "), v("name"), t("이고 "), v("address"), t("에 살고 있습니다.")],
            lambda: [v("name"), t(" "), t(self.one(TITLES)), t(" 말했다.")],
            lambda: [v("name"), t(self.one(TITLES)), t(" 참석했다.")],
            lambda: [t("이날 "), v("name"), t(" "), t(self.one(TITLES)), t(" 소식을 전했다.")],
            lambda: [t(self.one(["주무관 ", "담당자 ", "대표 ", "회원 ", "신고자 ", "대리인 ", "성명: ", "이름: "])), v("name"), t(self.one(["입니다.", "씨는 ", "은 ", ", ", " / ", "이"]))],
            lambda: [t("연락처는 "), v("phone"), t(self.one(["입니다.", "로 주세요.", " 입니다"]))],
            lambda: [t(self.one(["문의 ", "전화 ", "☎ ", "Tel. ", "문의: ", "팩스 ", "제보 "])), v("phone"), t(self.one(["", ".", ")", ", ", " / "]))],
            lambda: [t("답변은 "), v("email"), t(" 주소로 보내 주세요.")],
            lambda: [t(self.one(["메일 ", "이메일: ", "E-mail ", "전자우편 "])), v("email"), t(self.one(["", ".", "로", " 로", ", ", ">"]))],
            lambda: [t("본인 확인용 번호는 "), v("id_number"), t(self.one([" 맞습니다.", "입니다."]))],
            lambda: [t(self.one(["주민등록번호 ", "여권 ", "면허 번호 ", "외국인등록번호 ", "번호: "])), v("id_number"), t(self.one(["", ".", " 입니다.", "로 확인"]))],
            lambda: [t(self.one(["주소: ", "접수처는 ", "장소는 ", "행사는 "])), v("address"), t(self.one(["이다.", "에서 열린다.", "", " 앞입니다."]))],
            lambda: [v("name"), t(self.one([", ", " / ", " ", " ("])), v("phone"), t(self.one(["", ")", "\n"]))],
            lambda: [v("name"), t(" 기자 "), v("email")],
            lambda: [t("My name is "), ("name", self.latin_name()), t(" and I live at "), v("address"), t(". Call "), v("phone"), t(" please.")],
            lambda: [("name", self.latin_name()), t(self.one([" said so on Monday.", ", a teacher, agreed.", " told the paper.", " won the race."]))],
            lambda: [t(self.one(["Contact ", "Mayor ", "By ", "Reporter ", "coach ", "resident ", "Dr. "])), ("name", self.latin_name()), t(self.one([" for details.", ".", " at "])), v("email")],
        ])()

    def contact(self) -> list[tuple[str, str]]:
        """Parts of a short note of how someone can be reached."""
        kinds = ["name", "phone", "email", "address"]
        got: list[tuple[str, str]] = []
        for k in [self.one(kinds) for _ in range(int(self.r.integers(1, 3)))]:
            if got:
                got.append(("", self.one([", ", " / ", " ", "\n", "; "])))
            got.append((k, self.of(k)))
        return got
