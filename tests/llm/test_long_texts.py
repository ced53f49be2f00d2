import random
import re
import time

import public_tokenizers
import sentencepiece
import tiktoken

from tidemark.llm import byte_bpe, secrets, token_counts

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")


def plain_candidates(text, spans):
    """Character by character: what a run keeps once base spans took theirs."""
    taken = [False] * (len(text) + 1)
    for _, first, last, _ in spans:
        taken[first:last] = [True] * (last - first)
    found = []
    for m in RUN.finditer(text):
        start = None
        for i in range(m.start(), m.end() + 1):
            inside = i < m.end() and not taken[i]
            if inside and start is None:
                start = i
            if not inside and start is not None:
                if i - start >= 20:
                    found.append((start, i, text[start:i]))
                start = None
    return found


def test_rests_of_runs_equal_the_plain_way():
    rng = random.Random(5)
    parts = [
        "password: hunter2x", 'token="', "AKIA" + "Q" * 18, "ab12" * 7, "Zx9_" * 6, " ", "\n", "secret=", "-Kq" * 9, "word",
        "api_key = '", "QQ", "é",
    ]
    beside = 0
    for _ in range(2_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        spans = secrets.base_spans(text)
        got = secrets.candidates(text, spans, RUN)
        assert got == plain_candidates(text, spans), text
        beside += any(g[1] == s[1] or g[0] == s[2] for g in got for s in spans)
    assert beside > 100


def test_time_grows_with_the_text():
    text = ("password=hunter2 " + "Zx9_" * 8 + " ") * 50_000
    began = time.time()
    assert len(secrets.candidates(text, secrets.base_spans(text), RUN)) == 50_000
    assert time.time() - began < 10


def test_ids_do_not_depend_on_the_groups(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["abc", "  ", " don't", "\n\n ", "1234567", "日本語", "🙂🙂", "\t", "Straße", " x", "..."]
    for alphabet in (words, [w for w in words if w.isascii()]):
        text = "".join(rng.choice(alphabet) for _ in range(3_000))
        for at_once in (1, 7, 1_000):
            monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", at_once)
            packed = byte_bpe.Codec(ranks, public_tokenizers.PATTERN).encode_batch([text, "", "a"])
            ids = [int.from_bytes(packed[0][i : i + 4], "little") for i in range(0, len(packed[0]), 4)]
            assert ids == plain.encode_ordinary(text) and packed[1] == b""


def test_calls_hold_equal_bytes_and_parts_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "Ein Satz, der lang ist. " * 40 + "日本語 テキスト " * 40 + "plain words 12 34, end. " * 40
    parts = token_counts.safe_parts(text, 100)
    assert len(parts) > 5 and sum(len(model.encode(p)) for p in parts) == len(model.encode(text))
    sizes = [len(p.encode()) for p in ("é" * 50, "a" * 60, "b" * 30)]
    assert [sorted(c) for c in token_counts.calls_of(sizes, 100)] == [[0], [1, 2]]
