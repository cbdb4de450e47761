"""Tokens, packing, personal information, scanned pages and subjects on small inputs."""

import re
import random

import numpy as np
import pytest
import tiktoken

from presswork.llm import bpe, packing, pii, scanned, subjects, tokens

MERGES = bpe.load_merges(bpe.default_vocabulary())
ORACLE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=MERGES.ranks, special_tokens={})


@pytest.mark.parametrize("seed", range(25))
def test_streaming_ids_are_the_vocabulary_s(seed):
    r = random.Random(seed)
    alphabet = r.choice(["ab ", "한글가나다 ", "'s re ll\n\t 1", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?.-=", "é漢🎉x "])
    text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 7, 300, 5000])))
    s, out, i = bpe.StreamingEncoder(MERGES), b"", 0
    while i < len(text):
        n = r.choice([1, 3, 17, 900])
        out += s.feed(text[i : i + n])
        i += n
    ids = np.frombuffer(out + s.finish(), np.int32).tolist()
    assert ids == ORACLE.encode_ordinary(text) == np.frombuffer(bpe.encoder(bpe.default_vocabulary()).encode(text), np.int32).tolist()
    d = bpe.TextDecoder(MERGES)
    assert "".join(d.feed([x]) for x in ids) + d.finish() == text


def test_a_long_run_keeps_memory_constant():
    s = bpe.StreamingEncoder(MERGES)
    for _ in range(30):
        s.feed("aaab" * 2000)
    assert len(s.buf) < 10_000 and len(s.run.last) < 2000


def test_empty_and_null_texts_have_empty_lists(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.token_ids(d).collect())
    assert got == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert tokens.token_ids(d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_everything_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    for x in r.integers(1, [257, 60, 257, 9, 257, 130][seed], [500, 3000, 3, 5000, 0, 800][seed]):
        counts[x] += 1
    p = packing.Plan(counts, 256, 8, 3)
    fill = np.zeros(p.containers, np.int64)
    for length, got in enumerate(p.intervals):
        ends = [rank for rank, _ in got[1:]] + [int(counts[length])]
        assert not got or got[0][0] == 0
        for (rank, first), end in zip(got, ends):
            fill[first : first + end - rank] += length
    assert (p.used[1:] == counts[1:]).all() and (fill <= 256).all() and (fill > 0).all()
    assert fill.sum() == (counts * np.arange(257)).sum()


def test_pack_frame(spark):
    rows = [(i, n) for i, n in enumerate([10, 0, None, 100, 256, 257, 1000, 3, 3, 3, 250])] + [(50, 10), (50, 10)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 256, 8).collect()
    fill = {}
    for r in got:
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 256 and sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert sorted(r.n_tokens for r in got if r.doc_id == 6) == [232, 256, 256, 256]
    assert len([r for r in got if r.doc_id == 1]) == 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), 256, 8).count() == 0


def test_personal_information():
    weights = pii.WEIGHTS.read_bytes()
    text = "제 이름은 문시내이고 늘원군 온빛읍 바솔로 296-19에 살고 있습니다. 연락처는 010-1845-3618입니다. 답변은 onyu+yoon@gaon-mail.example 주소로 보내 주시기 바랍니다. 본인 확인용 번호는 590109-5014005 맞습니다. 사업자 번호 168-28-19701 업체가 현수막을 달았다. 당첨 명단에는 이○○, 김모 씨처럼 가려져 있었습니다."
    spans, none, empty = pii.find_spans([text, None, ""], weights)
    assert [(k, text[s:e]) for k, s, e in spans] == [("name", "문시내"), ("address", "늘원군 온빛읍 바솔로 296-19"), ("phone", "010-1845-3618"), ("email", "onyu+yoon@gaon-mail.example"), ("id_number", "590109-5014005")]
    assert none == [] and empty == []
    assert "[NAME]" in pii.replaced(text, spans) and "168-28-19701" in pii.replaced(text, spans)


@pytest.mark.parametrize(
    "text, want",
    [
        ("어제 남궁 민수 씨가 회의에 참석했다.", ("name", "남궁 민수")),
        ("회원 제갈 량 씨는 웃었다.", ("name", "제갈 량")),
        ("주민 김 훈 씨는 반대했다.", ("name", "김 훈")),
        ("Contact James Brown for details.", ("name", "James Brown")),
        ("문의 1588-1234 로 전화 주세요.", ("phone", "1588-1234")),
        ("Call +1 212-555-0147 please.", ("phone", "+1 212-555-0147")),
    ],
)
def test_values_that_no_list_or_shape_holds(text, want):
    assert want in [(k, text[s:e]) for k, s, e in pii.find_spans([text], pii.WEIGHTS.read_bytes())[0]]


def test_the_network_needs_no_shapes():
    import inspect

    assert "pii_forms" not in inspect.getsource(pii) and not hasattr(pii, "forms")


def test_texts_beside_it_don_t_change_a_text_s_spans():
    weights, r = pii.WEIGHTS.read_bytes(), random.Random(3)
    parts = ["이어 행정 협의회 시설을 점검했다. ", "연락처는 010-1845-3618입니다. ", "문시내 씨는 웃었다.\n", "메일 ab@cd.example 로 ", "My name is Na-rin Hong. "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    together = pii.find_spans(texts, weights)
    assert together == [pii.find_spans([t], weights)[0] for t in texts]
    assert together[::-1] == pii.find_spans(texts[::-1], weights)


def test_windows_and_pieces_don_t_change_what_is_found(monkeypatch):
    weights = pii.WEIGHTS.read_bytes()
    filler = "이어 행정 협의회 시설을 단계적으로 점검했다. "
    want = "연락처는 010-1845-3618입니다. "
    text = filler * 40 + want + filler * 40
    assert [(k, text[s:e]) for k, s, e in pii.find_spans([text], weights)[0]] == [("phone", "010-1845-3618")]
    monkeypatch.setattr(pii, "PIECE", 700)
    monkeypatch.setattr(pii, "MARGIN", 300)
    long = text * 5
    assert [long[s:e] for _, s, e in pii.find_spans([long, "", want], weights)[0]] == ["010-1845-3618"] * 5


def test_no_tag_follows_that_can_t():
    t, r = pii.tagger(pii.WEIGHTS.read_bytes()), np.random.default_rng(4)
    e = r.normal(0, 3, (400, len(pii.TAGS))).astype(np.float32)
    got = t.viterbi(e, np.asarray([0, 150]), np.asarray([150, 250]))
    for s, n in ((0, 150), (150, 250)):
        path = got[s : s + n]
        assert path[0] % 2 == 1 or path[0] == 0
        at = np.argsort(pii.INNER)
        score = lambda p: e[s, at[p[0]]] + sum(t.trans[at[a], at[b]] + e[s + i + 1, at[b]] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: E731, B023
        best = [score(np.r_[path[:i], v, path[i + 1 :]]) for i in range(n) for v in range(len(pii.TAGS)) if i or v % 2 or not v]
        assert max(best) <= score(path) + 1e-2


def test_spans_frame(spark):
    d = spark.createDataFrame([("f", 1, "메일 ab@cd.example 로", 0), ("f", 1, "메일 ab@cd.example 로", 0), ("f", 2, None, 0)], "field string, id bigint, text string, kind int")
    assert [tuple(r) for r in pii.personal_spans(d).collect()] == [("f", 1, 4, 13, "email")]
    assert sorted(r.text or "" for r in pii.masked(d).collect()) == ["", "메일 [EMAIL] 로", "메일 [EMAIL] 로"]


def noisy(spark):
    clean = "주민자치회는 도서관 자료를 모았다. 참여율을 묻는 조사에서 응답자들은 관심을 모았다."
    rows = [("articles.content", i, clean) for i in range(60)]
    rows += [("papers.content", 1, "가람일보   제12호   2024년 5월 1일 수요일\n주민자치회는 도서관 자료를 모았ㄷr. 관-\n심을 모았다.\n5 : 9\n- 3 -\n\n참여율올 묻는 조사에서"), ("articles.title", 1, "도서관 자료 13"), ("articles.title", 2, "2022 도서관 자료"), ("papers.content", 2, None), ("papers.content", 3, "")]
    rows += [("articles.content", 100 + i, "참여율올 묻는 조사에서") for i in range(1)]
    return spark.createDataFrame(rows, "field string, id bigint, text string").filter("text is not null")


def test_noise_lines(spark):
    got = {tuple(r) for r in scanned.noise_lines(noisy(spark), ["가람일보"]).collect()}
    assert {("papers.content", 1, 1, "header"), ("papers.content", 1, 2, "hyphen"), ("papers.content", 1, 2, "misread"), ("papers.content", 1, 5, "page_no"), ("articles.title", 1, 1, "page_no")} <= got
    assert not {g for g in got if g[2] == 4 or g[:2] == ("articles.title", 2) or g[0] == "articles.content" and g[1] < 60}


def known_counts(text, learned):
    tally = scanned.Tally()
    tally.add([text] * 60)
    keys = tally.keys()
    table = np.zeros(2 * scanned.LEAST, np.int32)
    for k, n in keys.items():
        for at in scanned.slots(k, scanned.LEAST):
            table[at] += n
    return scanned.Counts(table, keys["#"], learned)


def test_words_without_spaces_are_read():
    text = "주민자치회는 도서관 자료를 모았다 참여율을 묻는 조사에서 응답자들은 관심을 모았다"
    reader = scanned.Reader(known_counts(text, {("을", "올"): 0.001}), [])
    clean = text.replace(" ", "") * 2
    bad = clean[:40] + clean[40:].replace("참여율을", "참여율올")
    assert len(clean) > 60 and bad != clean
    assert reader.kinds(clean) == [] and reader.kinds(bad) == [(1, "misread")]
    assert reader.repaired(f"{bad}.") == f"{clean}."
    tally = scanned.Tally()
    tally.add([clean])
    assert tally.keys()["w" + clean] == 1


def test_misprints_of_letters_and_digits():
    text = "the council closed doors of 00.0% 00월 가운데 주민자치회"
    reader = scanned.Reader(known_counts(text * 5, {("e", "c"): 0.003, ("u", "ii"): 0.003}), [])
    bad = ["the counci1 met", "c1osed doors", "thc doors", "coiincil", "the b2.5% 가운데", "1l월 가운데", "Z5월", "가운데 l2.5%"]
    assert [b for b in bad if reader.kinds(b) != [(1, "misread")]] == []
    assert [b for b in ("the 12.5% 가운데", "11월 가운데", "closed doors", "가운데(59)", "주민자치회(37) 주민자치회11") if reader.kinds(b)] == []


def test_misprints_are_learned(spark):
    """Two misprints befall all words alike and are learned, of one and of two characters; an ending
    of one word isn't."""
    syllables = "가나다라마바사아자차카타파하"
    words = [(f"{x}{y}을", 1000) for x in syllables for y in syllables[:4]]
    words += [(f"{x}{y}올", 4) for x in syllables for y in syllables[:4]] + [(f"{x}{y}tion", 1000) for x in "abcdefgh" for y in "mnp"] + [(f"{x}{y}non", 4) for x in "abcdefgh" for y in "mnp"]
    words += [("가가은", 40), (None, 5), ("", 9)]
    sizes, pairs = scanned.frequent_and_rare(spark.createDataFrame(words, "w string, n bigint"))
    got = scanned.likely_pairs([tuple(r) for r in sizes.collect()], [tuple(r) for r in pairs.collect()])
    assert set(got) == {("을", "올"), ("ti", "n")} and abs(got["을", "올"] - 0.004) < 1e-9


def test_all_known_candidates_are_kept():
    true = "가나다라마바사"
    channel = scanned.Channel(known_counts(" ".join(f"{x}말" for x in true), {(x, "하"): 0.001 for x in true}))
    assert {w for w, _ in channel.candidates("하말")} == {"하말", *(f"{x}말" for x in true)}


def test_repaired(spark):
    got = {(r.field, r.id): r.text for r in scanned.repaired(noisy(spark), ["가람일보"]).collect()}
    assert got["papers.content", 1].split("\n")[0].startswith("주민자치회는 도서관 자료를 모았다. 관심을 모았다.")
    assert got["articles.title", 1] == "도서관 자료"
    assert scanned.noise_lines(noisy(spark).limit(0), []).count() == 0


def test_subjects(spark):
    topic = {"farm": ["과수원", "모내기", "농기계", "냉해"], "law": ["공소장", "벌금형", "변호인", "항소심"]}
    r = random.Random(2)

    def doc(*names):
        return "\n".join(f"{r.choice(topic[n])} {r.choice(topic[n])} 소식을 주민들이 지켜봤다." for n in names for _ in range(4))

    rows = [(i, doc(("farm", "law")[i % 2])) for i in range(300)] + [(900, doc("farm", "law")), (901, None), (902, ""), (903, "주민들이 소식을 지켜봤다. 모두 돌아왔다.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, ("farm", "law")[i % 2]) for i in range(60)] + [(3, "farm"), (5000, "law")], "doc_id bigint, subject string")
    names = spark.createDataFrame([("farm",), ("law",)], "subject string")
    found = {}
    for x in subjects.subject_shares(docs, labels, names).collect():
        found.setdefault(x.doc_id, set()).add(x.subject)
    assert np.mean([found.get(i) == {("farm", "law")[i % 2]} for i in range(300)]) > 0.95
    assert found[900] == {"farm", "law"}
    assert not {901, 902, 903} & set(found)
    assert subjects.subject_shares(docs, labels.limit(0), names).count() == 0


def test_texts_are_hashed_together_as_each_alone():
    texts = ["서울시는 오늘 새 계획을 발표했다. 2024년 예산은 a_b 로 쓴다!\n\n둘째 줄이다", None, "", "x", "One more line. " * 3, "²x Ⅷ 가나1다 오늘 새 \ud800y 𠀀字 ١٢ z\x00w"]
    words = subjects._Words()
    ends, terms, at = subjects.hashed_all(texts, words, {})
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        want = set()
        found = subjects.sentences(text) if text else []
        for i, s in enumerate(found):
            h = [words[w] for w in re.findall(r"[^\W\d_]+", s)]
            want |= {((x >> 7) % subjects.BUCKETS, i) for x in h if x}
            want |= {(((x * 0x9E3779B97F4A7C15 ^ y * 0xC2B2AE3D27D4EB4F) % (1 << 64) >> 13) % subjects.BUCKETS, i) for x, y in zip(h, h[1:])}
        rows = list(zip(terms[begin:end].tolist(), at[begin:end].tolist()))
        assert rows.pop() == (-1, len(found)) and len(rows) == len(want) and set(rows) == want
        begin = end


def test_tag_scores_come_with_the_gates_of_the_next_step():
    t = pii.tagger(pii.WEIGHTS.read_bytes())
    k, n, steps = t.hidden, len(pii.TAGS), 7
    assert t.mix.shape[1] == 4 * k + n
    ids = np.random.default_rng(3).integers(0, t.emb.shape[1], (steps, 2, pii.BATCH))
    got = t.scores(ids).reshape(2, steps, pii.BATCH, n)
    for d in (0, 1):
        h, c = np.zeros((k, pii.BATCH)), np.zeros((k, pii.BATCH))
        for i in range(steps):
            g = np.clip(t.mix[d, : 4 * k] @ np.concatenate([h, t.emb[:, ids[i, d]]]), 0, 1)
            c = np.clip(c * g[k : 2 * k] + g[:k] * (g[3 * k :] - 0.5), -0.5, 0.5)
            h = g[2 * k : 3 * k] * c
            assert np.allclose(got[d, i], (t.out[d] @ h).T, atol=1e-3)
