"""Personal data, pieces, lengths and rules against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD_TEXTS, SF_DIR, documents, prose, rows_of

from docweave.llm import lengths, pieces, pii, queries, rules
from docweave.llm.common import read_table

ALPHABET = "ab1 2.-+@()_%\n\t,0937é▁  <s></s>日😀#|\0"


def random_texts(count, seed=1, longest=60):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in read_table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}


# Personal data


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
}


def brute_spans(text):
    found = [
        (m.start(), k, m.end())
        for k, (pattern, valid) in enumerate(RULES.values())
        for m in re.finditer(pattern, text or "")
        if valid(m[0])
    ]
    return sorted(found)


HARD = ["1.2.3.4.5 a@b..c a@b.c.@d.e 4111 1111-1111 1111 +49 (30) 1234-5678.", "+1" * 400, "256.1.1.1 000255.1.1.01", "1.1.1", "+12", "+1 2"]


def test_base_spans_are_those_of_the_patterns(texts):
    find = pii.span_finder()
    for text in [*filter(None, ODD_TEXTS), *HARD, *texts.values(), *random_texts(5000)]:
        assert [s for s in find(text) if s[1] < 4] == brute_spans(text)


def test_more_kinds_and_boundaries():
    find = pii.span_finder()
    text = "See https://x.example/a?b=1, IBAN DE89 3704 0044 0532 0130 00, account no. 12345678 at 12 Old Mill Road."
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in find(text) if k > 3]
    assert found == [
        ("url", "https://x.example/a?b=1"),
        ("account", "DE89 3704 0044 0532 0130 00"),
        ("account", "12345678"),
        ("address", "12 Old Mill Road"),
    ]
    for clean in ("the broad street", "on account of 3 things", "a road. 5", "www. nothing", "iban"):
        assert find(clean) == []


def test_cues_in_any_case_and_long_street_names():
    find = pii.span_finder()
    cases = {
        "Customer ID: 12345678": [("account", "12345678")],
        "aCCOUNT 12345678 hTTps://a.b/c": [("account", "12345678"), ("url", "https://a.b/c".replace("https", "hTTps"))],
        "KONTO: 998877 in LANGE STRASSE 12, Große Straße 5": [
            ("account", "998877"), ("address", "STRASSE 12"), ("address", "Straße 5"),
        ],
        f"at 7b, {'Saint-' * 40}Peter Hill rOAd now": [("address", f"7b, {'Saint-' * 40}Peter Hill rOAd")],
        f"12 {'long' * 5000} Mill-street": [("address", f"12 {'long' * 5000} Mill-street")],
        "12 one two three four street, x-12 Old Lane": [("address", "12 Old Lane")],
    }
    for text, wanted in cases.items():
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in find(text) if k > 3] == wanted, text[:60]


def test_street_names_are_those_of_a_pattern():
    pattern = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]?,? (?:[^\W\d_][\w.'-]*[ -]){0,3}?(?:street|lane)(?![^\W_])")
    find, pick = pii.span_finder(), random.Random(4)
    parts = ["12", "7a", "123456", ", ", " ", " ", " ", "-", "Old", "x.", "street", "street", "lane", "\n", "é"]
    for _ in range(20_000):
        text = "".join(pick.choices(parts, k=pick.randint(2, 16)))
        wanted = [m.span() for m in pattern.finditer(text)]
        assert [(a, b) for a, k, b in find(text) if pii.KINDS[k] == "address"] == wanted, repr(text)


def test_long_chains_of_street_words_take_linear_time():
    find = pii.span_finder()
    for text in ("x-street-" * 60_000, "street " * 80_000, "12 " + "street-" * 80_000):
        started = time.perf_counter()
        find(text)
        assert time.perf_counter() - started < 10


def test_pii_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_pii"](spark, SF_DIR).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        spans = brute_spans(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[key]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[key][f"n_{kind}"] for kind in pii.BASE_KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(joined.split(",")) - {""} <= set(got[key]["spans"].split(","))


def test_masking_keeps_rows_and_columns(spark):
    docs = documents(spark, [*ODD_TEXTS, "mail a.b@c.de or +49 30 1234567 now"], True)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    by_id = {r["doc_id"]: r for r in masked.collect()}
    assert by_id[len(ODD_TEXTS)]["text"] == "mail [EMAIL] or [PHONE] now"
    assert by_id[0]["text"] is None and by_id[15]["text"] == "same text here"
    assert {r["found"] for r in by_id.values()} == {"x"}
    assert pii.mask_text("abcdef", [(1, 0, 4), (2, 4, 5)]) == "a[EMAIL]f"


# Pieces


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def test_ids_are_the_library_s(model, texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encode = pieces.segmenter(model)
    some = [*filter(None, ODD_TEXTS), "", *texts.values(), *random_texts(3000, 2)]
    for text, ids in zip(some, encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_a_full_table_is_emptied(model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 10)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encode = pieces.segmenter(model)
    for text in random_texts(300, 3):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_sentencepiece_rows(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = documents(spark, ODD_TEXTS, True)
    got = {r["doc_id"]: r for r in pieces.encode_decode(docs, model).select("doc_id", *pieces.digests()).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert pieces.encode_decode(docs.where("false"), model).collect() == []


def test_models_with_pieces_across_markers_are_refused(model, monkeypatch):
    pieces.check_model(model)
    real = sentencepiece.SentencePieceProcessor

    class Crossing(real):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces.check_model(model)


# Lengths


def test_histogram_answers_all_limits(spark, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 4)
    sizes = [0, 0, 3, 3, 3, 4, 9, 9, 17, 40]
    hist = lengths.length_histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens bigint"))
    for row in hist.collect():
        size = row["n_tokens"]
        assert row["n_docs"] == sizes.count(size)
        assert row["docs_at_least"] == sum(s >= size for s in sizes)
        assert row["tokens_at_least"] == sum(s for s in sizes if s >= size)
        assert row["truncated_tokens"] == sum(min(s, size) for s in sizes)
        assert row["quantile"] == sum(s <= size for s in sizes) / len(sizes)
    assert lengths.total(hist).first()[0] == sum(sizes)
    for limit in range(45):
        assert lengths.truncated_total(hist, limit).first()[0] == sum(min(s, limit) for s in sizes)
    assert lengths.quantile(hist, 0.5).first()[0] == 3
    empty = hist.where("false")
    assert (lengths.total(empty).first()[0], lengths.quantile(empty, 0.5).first()[0]) == (0, None)


def test_token_count_query(spark, texts):
    import tiktoken

    ranks = queries._file("byte_bpe_50k.tiktoken")
    import base64

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    sizes = [len(encoding.encode_ordinary(t or "")) for t in texts.values()]
    got = {r["n_tokens"]: r for r in queries.QUERIES["op4_token_counts"](spark, SF_DIR).collect()}
    assert {s: r["n_docs"] for s, r in got.items()} == {s: sizes.count(s) for s in set(sizes)}
    assert got[max(sizes)]["truncated_tokens"] == sum(sizes)
    odd = lengths.encoded_lengths(documents(spark, ODD_TEXTS, True), ranks, public_tokenizers.PATTERN)
    assert dict(map(tuple, odd.collect())) == {
        i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(ODD_TEXTS)
    }


# Rules


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + j for found in places.values() if len(found) > 1 for i in found for j in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
    )


def test_statistics_are_exact(spark, texts):
    hashes = rules._Hashes()
    extra = ["a b c d e a b c d e a", "a " * 50, "x\n\x0b\nx\n \ny", "a\x85b c d"]
    for text in [*ODD_TEXTS, *extra, *texts.values(), *random_texts(2000, 4)]:
        assert rules.text_statistics(text or "", hashes)[:5] == brute_statistics(text)


def test_rules_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality_rules"](spark, SF_DIR).collect()}
    assert set(got) == set(texts)
    for key, text in texts.items():
        n, chars, symbols, dup, repeat = brute_statistics(text)
        row = got[key]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert row["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (row["base_failed"] and row["kept"])


def noise(i):
    return prose(i, 40).replace(" ", "### ")


def test_rules_learn_and_keep_clean_rows(spark):
    stats = rules.statistics(documents(spark, [prose(i) if i % 4 else noise(i) for i in range(200)]))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)] + [(1, None), (None, 0), (9999, 0)], "doc_id bigint, quality int")
    learned = rules.fit(stats, labels)
    assert learned
    kept = {r[0] for r in stats.where(rules.verdict(learned)).select("doc_id").collect()}
    assert kept == {i for i in range(200) if i % 4}
    # The sample is bounded, and a bound smaller than the labels still learns.
    assert rules.fit(stats, labels, train_rows=80)


def test_nothing_to_learn_keeps_all(spark):
    stats = rules.statistics(documents(spark, ODD_TEXTS, True))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert rules.fit(stats, none) == []
    assert stats.where(rules.verdict([])).count() == len(ODD_TEXTS)
    only_good = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int")
    assert rules.fit(stats, only_good) == []
    assert rows_of(rules.statistics(documents(spark, ["x"]).where("false"))) == []
