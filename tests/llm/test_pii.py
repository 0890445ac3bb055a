"""PII: base spans against a plain regex scan, and what is learned against a plain version of the bootstrap."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import xxhash

from quadspark.llm.pii import KINDS, extract_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    s = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data", "a@b.c@d.e _x@y.z", "mail me: some.one+tag@mail.example.com, now", "1.2.3.4.5 300.1.1.1 007.0.0.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (386) 555-3733 +12 3 + 4", "é😀 9.9.9.9 ü +49 30 1234567)", "a@b..c a@-.-", "1" * 5000, "x" * 5000 + "@a.b",
    "a" * 3000 + ".b" * 3000, "q@" + "a.b" * 4000, "٣٤ 1.2.3.4 5.6.7.8", "@@@ a@b a@b.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1.+2.3456789-0",
]


@pytest.mark.parametrize("repeat", [1, 2])
def test_base_spans(spark, repeat):
    rows = [(i, t) for i, t in enumerate(TEXTS)] * repeat
    got = extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(TEXTS[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), TEXTS[r.doc_id]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        for k in KINDS:
            assert r[f"n_{k}"] == sum(x == k for x, _, _ in want)


def test_driver_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in extract_pii(rows).collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_learned_context(spark):
    rows = [(i, f"please write Hotline: +1 (386) 555-{1000 + i} or wait") for i in range(30)] + [(100, "the Hotline: 555-123-4567, always"), (101, "size 555-123-4567 here")]
    got = {r.doc_id: r for r in extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:13:25" and got[100].n_learned == 1 and got[100].n_phone == 0
    assert got[101].spans == ""


def test_patterns_of_learned_instances(spark):
    """A learned number makes the word before its other places a pattern, and so on; numbers may be of several words."""
    rows = [(i, f"please write Hotline: +1 (386) 555-{1000 + i} then") for i in range(200)]
    rows += [(1000 + i, f"the Hotline: 555-123-40{i:02d}, always") for i in range(40)]
    rows += [(1200 + i, f"see Desk: 555-123-40{i:02d} later") for i in range(40)]
    rows += [(1300 + i, f"or Desk: 555-777-60{i:02d}, or") for i in range(8)] + [(1400 + i, f"a Bell: 555-777-60{i:02d}, b") for i in range(8)] + [(500, "our Bell: 555-888-7000, yes")]
    rows += [(600, "the Hotline: 555 123 9999, always"), (601, "the Hotline: +1 (826) 555-4081 190.137.223.204 end"), (602, "nothing 555-888-7001, here")]
    got = {r.doc_id: r for r in extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1200].spans == "phone:10:22" and got[500].spans == "phone:10:22" and got[600].spans == "phone:13:25"
    assert got[601].spans == "ip:31:46,phone:13:30" and got[601].n_learned == 1 and got[601].n_phone == 0
    assert got[602].spans == ""


def test_word_after(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} +1 (386) 555-{1000 + i} (callback)") for i in range(30)] + [(100, "so 555-123-4567 (callback)")]
    got = {r.doc_id: r for r in extract_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:3:15"


def test_empty(spark):
    assert extract_pii(spark.createDataFrame([], "doc_id long, text string, row int, kind string")).collect() == []


def split_words(text):
    return [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


SHAPE = {
    "email": r"[^@]+@[^@]+",
    "card": r"[0-9]([ -]?[0-9]){11,}",
    "phone": r"[+(]{0,2}[0-9][ ().0-9-]{5,}[0-9]",
    "secret": r"[A-Za-z0-9][A-Za-z0-9_+/.=-]{7,}",
}


def fits(kind, token):
    if kind == "ip":
        parts = token.split(".")
        return len(parts) >= 3 and all(re.fullmatch("[0-9]+", p) and int(p) <= 255 for p in parts)
    if not re.fullmatch(SHAPE[kind], token):
        return False
    if kind == "secret":
        return bool(re.search("[0-9]", token) and re.search("[A-Za-z]", token))
    return kind != "phone" or " " not in token or len(re.sub("[^0-9]", "", token)) <= 15


def valid(kind, token):
    digits = re.sub("[^0-9]", "", token)
    if kind == "ip":
        return len(token.split(".")) == 4
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits)


def around(text, spans):
    """Of spans in order, the last two words before each and the first after it, back and on to the next span."""
    out = []
    for k, (a, b) in enumerate(spans):
        left = text[spans[k - 1][1] if k else 0 : a]
        left = re.sub(r"(?<=[\x20\x09-\x0D])[(\[{<\"']+$", "", left)
        right = text[b : spans[k + 1][0] if k + 1 < len(spans) else len(text)]
        after = re.match(r"[.,;:!?)\]}>\"']*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", right)
        out.append((" ".join(w for _, w in split_words(left)[-2:]).lower(), after[1].lower() if after else ""))
    return out


def candidates(text):
    """(kind or None, at, start, end, before, after) of base spans and free candidates."""
    out = []
    for kind in KINDS:
        all_ = [(m.start(), m.end()) for m in re.finditer(PLAIN[kind], text)]
        ok = {(a, b) for k, a, b in brute(text) if k == kind}
        out += [(kind, a, a, b, *c) for (a, b), c in zip(all_, around(text, all_), strict=True) if (a, b) in ok]
    base = [(a, b) for _, _, a, b, *_ in out]
    more = []
    words = [(a, a + len(w)) for a, w in split_words(text) if re.search("[0-9@]", w)]
    for (a, b), (before, after) in zip(words, around(text, words), strict=True):
        w, at = text[a:b], a
        cut = len(re.match(r"[(\[{<\"']*", w)[0])
        bare = re.sub(r"[.,;:!?)\]}>\"']*$", "", w[cut:])
        m = re.match(r"([A-Za-z_][A-Za-z0-9_.-]*)([=:])[\"'(\[{<]*(?=[^=:/]*[0-9@])(?![=:/])", bare)
        if m:
            before, at = f"{m[1]} {m[2]}".lower(), a + cut + m.end()
        skip = m.end() if m else 0
        token = bare[skip:]
        if w[: cut + skip][-1:] in ('"', "'"):
            token = re.match(r"[^\"']*", token)[0]
        if token:
            more.append((at, a + cut + skip, token, before, after))
    unit = r"[+(]{0,2}[0-9][().0-9-]*(?![^\x20\x09-\x0D,;:!?\]}>\"'])"
    groups = [(m.start(), m.end()) for m in re.finditer(rf"(?<![^\x20\x09-\x0D]){unit}(?:\x20{unit})+", text)]
    for (a, b), (before, after) in zip(groups, around(text, groups), strict=True):
        w = split_words(text[a:b])
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                token = re.sub(r"[.)-]*$", "", " ".join(x for _, x in w[i:j]))
                if 8 <= len(re.sub("[^0-9]", "", token)) <= 19:
                    last = before if i == 0 else " ".join(x for _, x in w[max(0, i - 2) : i])
                    more.append((a + w[i][0], a + w[i][0], token, last, w[j][1] if j < len(w) else after))
    for at, start, token, before, after in more:
        end = start + len(token)
        reach, ahead = max((y for x, y in base if x <= start), default=0), min((x for x, _ in base if x >= start), default=end)
        if reach <= start and ahead >= end:
            out.append((None, at, start, end, before, after))
    return out


def plain(texts, confidence=0.8, support=5, tolerance=0.001):
    """Learned spans (kind, start, end) of each text, by plain loops."""
    marks = []  # row, start, end, token, kinds by side, seed, words by side, places by side
    for row, text in enumerate(texts):
        for kind, at, start, end, before, after in candidates(text or ""):
            token = text[start:end]
            named = re.match(r"(?:[^\x20]+\x20)?([^\x20=:]+)\x20?([=:])$", before)
            two = f"{named[1]} {named[2]}" if named else before if " " in before else ""
            form = re.sub("[0-9]", "9", token) if re.fullmatch("[+0-9 ().-]+", token) else ""
            inner = [kind] if kind else [k for k in (*KINDS, "secret") if fits(k, token)]
            own = [kind] if kind else [k for k in ("ip", "card", "phone") if fits(k, token) and valid(k, token)]
            mixed = re.fullmatch(r"[A-Za-z0-9_+/=-]{20,}", token) and re.search("[0-9]", token) and re.search("[A-Za-z]", token) and len(set(token)) >= 10
            seed = bool(kind or (named and mixed and " " not in token))
            words = {0: before.split(" ")[-1], 1: after, 2: two, 3: form}
            marks.append((row, start, end, token, {0: inner, 1: inner, 2: inner, 3: own}, seed, words, {0: at, 1: end, 2: at, 3: (start, end)}, kind))
    places = defaultdict(list)
    for m in marks:
        for side, word in m[6].items():
            if word:
                places[side, word, m[0], m[7][side]].append(m)
    graph = defaultdict(lambda: defaultdict(lambda: (set(), set())))
    key = lambda t: int.from_bytes(xxhash.xxh64((t or "").encode(), seed=42).digest(), "big", signed=True)
    for (side, word, row, _), ms in places.items():
        longest = max((len(m[3]), m[3]) for m in ms)[1]
        hashes, members = graph[side, word][longest]
        hashes.add(key(texts[row]))
        members.update((m[3], k, m[5]) for m in ms for k in m[4][side])
    sure = {}
    score = {}
    while True:
        now = {}
        for (side, word), instances in graph.items():
            for k in (*KINDS, "secret"):
                s = [(max((1.0 if seed else score.get((t, x), 0.0) if side != 3 else 0.0 for t, x, seed in members if x == k), default=0.0), min(hashes)) for hashes, members in instances.values()]
                c = sum(x for x, _ in s) / (len(s) + 0.5)
                if c >= confidence and len({h for x, h in s if x >= 0.5}) >= support:
                    now[side, word, k] = c
        done = all(abs(now.get(p, 0) - sure.get(p, 0)) <= tolerance for p in {*now, *sure})
        sure = now
        if done:
            break
        by = defaultdict(lambda: 1.0)
        for (side, word, k), c in sure.items():
            for t, x in {(t, x) for _, members in graph[side, word].values() for t, x, _ in members if x == k}:
                by[t, x] *= 1 - c
        score = {p: 1 - v for p, v in by.items()}
    out = defaultdict(list)
    found = defaultdict(dict)
    for row, start, end, _, kinds, _, words, _, kind in marks:
        if kind is None:
            for k in (*KINDS, "secret"):
                left = math.prod(1 - sure[side, words[side], k] for side in range(4) if k in kinds[side] and (side, words[side], k) in sure)
                if left < 1:
                    found[row][start, end] = max(found[row].get((start, end), (0, "")), (round(1 - left, 9), k))
    for row, spans in found.items():
        for (a, b), (c, k) in sorted(spans.items(), key=lambda x: (-x[1][0], x[0][0] - x[0][1], x[0][0])):
            if all(b <= x or y <= a for _, x, y in out[row]):
                out[row].append((k, a, b))
    return [sorted(out[r]) for r in range(len(texts))]


def learned(spark, texts):
    rows = extract_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    out = {}
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = brute(texts[r.doc_id])
        assert r.n_spans == len(spans) and r.n_learned == len(spans) - len(base)
        for x in base:
            spans.remove(x)
        out[r.doc_id] = sorted(spans)
    return [out[i] for i in range(len(texts))]


def test_contexts_of_each_kind(spark):
    """Planted contexts of every kind, and noise that must stay out."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    key = lambda n: "".join(rng.choice("0123456789abcdefghXYZ") for _ in range(n - 2)) + "a1"
    long = "l" * 90
    texts = [None, "", "no data", "version 2.0, by-nc 4.0 and 3"]
    for i in range(50):
        mail, ip = f"{word()}@{word()}.org" if i < 42 else f"{word()}{i}@{word()}", f"10.{rng.randrange(256)}.{rng.randrange(256)}.7" if i < 42 else f"10.{rng.randrange(256)}.9"
        card = "4111 1111 1111 1111" if i < 5 else "4" + digits(15)
        while i < 42 and not luhn(re.sub(" ", "", card)):
            card = "4" + digits(15)
        phone = f"+1 ({digits(3)}) 555-{digits(4)}" if i < 42 else f"{digits(3)} {digits(3)} {digits(4)}"
        texts.append(f"{word()} from: <{mail}> {word()} host\t \n{ip}; {word()} {long} {card}, {word()} tel{' ' * 60}{phone} (day) {word()} {digits(16)} {word()}")
        if i >= 42:
            texts.append(f"{word()} desk {phone}, {word()}")
    texts += [f"{word()} desk 555-77{i}-0{i}00 {word()}" for i in range(1)]
    for i in range(12):
        forms = [f'token = "{key(32)}"###', f"token={key(30)}", f"token: '{key(28)}' {word()}", f"TOKEN = {key(40)},"]
        texts.append(f"{word()} {forms[i % 4]} {word()} x = {digits(3)} see http://a.b/c?id={digits(9)}")
    texts += [f"{word()} token = {key(9)} {word()}", f"commit {key(40)} {word()}", f"id = {digits(6)} {word()}", "+1 (826) 555-4081 190.137.223.204", f"{word()} +1 (826) 555-4081 17 +1 (826) 555-4082 3 4"]
    texts += texts[-5:]
    got, want = learned(spark, texts), plain(texts)
    assert got == want
    kinds = {k for spans in got for k, _, _ in spans}
    assert kinds == {*KINDS, "secret"} and got[3] == []
    # a weak value after a name that was learned from long ones; a hash without a name stays out
    assert [k for k, _, _ in got[-5]] == ["secret"] and got[-4] == [] and got[-3] == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_driver_rows_against_the_plain_version(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    got = learned(spark, texts)
    assert got == plain(texts)
    if sf == "sf0.01":  # every planted secret, and nothing else
        secrets = [(i, m.start(1), m.end(1)) for i, t in enumerate(texts) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")]
        assert secrets and sorted((i, a, b) for i, s in enumerate(got) for _, a, b in s) == sorted(secrets)


def test_clashing_columns(spark):
    row = (1, "mail a@b.cd", 5, "x", "y", [1])
    got = extract_pii(spark.createDataFrame([row, row, (None, None, None, None, None, None)], "doc_id long, text string, row int, kind string, token string, found array<int>")).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", "email:5:11"), ("1", "email:5:11"), ("None", "")]
