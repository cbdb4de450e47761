"""Shapes of personal information: where it may stand in the training texts. Used in training only."""

from __future__ import annotations

import regex

KINDS = ["email", "phone", "id_number", "address", "name"]

D = r"[0-9０-９]"
_DASH = r"[-‐‑‒–—−－~∼～.．·]"
_SEP = rf"(?:\s?{_DASH}\s?|[ \t　])"
_AT = r"(?:\s?[@＠]\s?|\s?[(\[{]\s?(?:at|AT|골뱅이)\s?[)\]}]\s?|\s+(?:at|AT)\s+|\s?골뱅이\s?)"
_DOT = r"(?:[.．]|\s+(?:dot|DOT)\s+|\s?[(\[]\s?(?:dot|DOT)\s?[)\]]\s?)"
_LOCAL = rf"[A-Za-z0-9][A-Za-z0-9_+%-]*(?:{_DOT}[A-Za-z0-9_+%-]+)*"
EMAIL = regex.compile(rf"(?<![A-Za-z0-9._+%-]){_LOCAL}{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])")

# Area and network codes, without the leading 0.
_CODE = r"(?:[1１][0０1１6６7７8８9９]|[2２]|[3３][1-3１-３]|[4４][1-4１-４]|[5５][0-5０-５]|[6６][1-4１-４]|[7７][0０]|[8８][0０])"
_COUNTRY = r"(?:[(（]\s?[+＋]\s?[8８][2２]\s?[)）]|[+＋]\s?[8８][2２])"
_OWN = rf"(?:[(（]\s?[0０]{_CODE}\s?[)）]\s?{_DASH}?\s?|[0０]{_CODE}(?:\s?[)）]\s?|{_SEP})?)"
_ABROAD = rf"(?:{_COUNTRY}(?:{_SEP})?(?:[(（]\s?[0０]?\s?[)）]\s?)?(?:[(（]\s?[0０]?{_CODE}\s?[)）]|[0０]?{_CODE})(?:{_SEP})?)"
_N = "[공영일이삼사오육륙칠팔구]"
PHONE = regex.compile(
    rf"(?<![0-9０-９A-Za-z*])(?<!{D}[-–.])(?:{_ABROAD}|{_OWN}){D}{{3,4}}{_SEP}?{D}{{4}}(?![0-9０-９*])(?!{_DASH}{D})"
    rf"|(?<![가-힣])[공영]{_N}{{1,2}}(?:\s?[-–]\s?|\s)?{_N}{{3,4}}(?:\s?[-–]\s?|\s)?{_N}{{4}}(?!{_N})"
)

_DAY = r"[0-9０-９]{2}(?:[0０][1-9１-９]|[1１][0-2０-２])(?:[0０][1-9１-９]|[12１２][0-9０-９]|[3３][01０１])"
ID_NUMBER = regex.compile(
    rf"(?<![0-9０-９-]){_DAY}\s?{_DASH}?\s?[1-8１-８]{D}{{6}}(?![0-9０-９*])"
    rf"|(?<![A-Za-z0-9])[A-Za-zＡ-Ｚ]{D}{{3}}[A-Za-zＡ-Ｚ]{D}{{4}}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[MSRODGmsrodg]{D}{{8}}(?![A-Za-z0-9])"
    rf"|(?<![0-9０-９-]){D}{{2}}\s?{_DASH}\s?{D}{{2}}\s?{_DASH}\s?{D}{{6}}\s?{_DASH}\s?{D}{{2}}(?![0-9０-９-])"
)

_LOT = rf"(?:산\s?)?{D}+(?:\s?-\s?{D}+)?(?:\s?번지)?"
_UNIT = rf"(?:,?\s?(?:[가-힣]+\s?(?:아파트|빌라|타워)\s?)?{D}+동\s?{D}+호|,?\s(?:지하\s?)?{D}+층(?:\s?{D}+호)?|,?\s{D}+호)?"
_TOWN = r"(?=[가-힣]+(?:도|시|군|구|읍|면|동)\s)(?:[가-힣]{1,5}(?:특별자치도|특별시|광역시|도|시|군|구)\s+)*(?:[가-힣]{1,4}(?:읍|면|동|구)\s+)*"
_ROAD = rf"(?![가-힣]*(?:으로|별도로|까스로|서로|바로|새로|스스로)\s)[가-힣]{{1,5}}(?:대로|로|길)(?:\s?{D}+번?길)?\s?{D}+(?:\s?-\s?{D}+)?(?:번지|번)?"
_VILLAGE = rf"[가-힣]{{1,4}}(?:리|동)\s+{_LOT}"
ADDRESS = regex.compile(
    rf"(?<![가-힣])(?:{_TOWN}(?:{_ROAD}|(?:[가-힣]{{1,4}}리\s+)?{_VILLAGE}){_UNIT})(?![0-9０-９]|\s?(?:건|가지|차례|회|명|개|월|일|년|만|억|원|kg|%|:\s?[0-9]|\.[0-9]|,[0-9]))"
    r"|(?<![0-9A-Za-z])[0-9]+(?:-[0-9]+)?,\s[A-Z][a-z]+-(?:daero|ro|gil)(?:\s[0-9]+(?:beon)?-gil)?(?:,\s[A-Z][a-z]+-(?:ri|eup|myeon|dong|gu))*,\s[A-Z][a-z]+-(?:si|gun|gu|do)(?![a-z])"
)

# Common Korean family names, and how they are written in Latin letters.
FAMILY = "김이박최정강조윤장임한오서신권황안송전홍문배류유고양손백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예경봉사부"
FAMILY_COMMON = "김이박최정강조윤장임한오서신권황안송전홍문배"
LATIN_FAMILY = "Kim Lee Park Choi Jung Jeong Kang Cho Yoon Jang Lim Han Oh Seo Shin Kwon Hwang Ahn Song Jeon Hong Moon Bae".split()
_LATIN = "|".join(LATIN_FAMILY)
LATIN_NAME = regex.compile(rf"(?<![A-Za-z-])(?:(?:{_LATIN})\s[A-Z][a-z]+-[a-z]+|[A-Z][a-z]+-[a-z]+\s(?:{_LATIN}))(?![A-Za-z-])")
FORMS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "address": ADDRESS}
#: What makes a name-like word something else: a building, a road, a town.
NOT_A_PERSON = regex.compile(r"\s?(?:아파트|빌라|타워|빌딩|초등학교|중학교|고등학교|도서관|공원|대로|로\s?[0-9]|길\s?[0-9])")
