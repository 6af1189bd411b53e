"""Fill-in-the-middle, alignment of tokenizers, chat formatting: against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import chat_format, fim, token_alignment
from tallyglass.llm.chat_format import TEMPLATE, ChatTemplate, GrammarError

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n\t", "one", " lead and trail \n", "a  b\x0bc\x1cd", "naïve   中文 text 🙂 é", "has <S> inside", "<P", "tie tie tie", "tie tie tie",
    "<|endoftext|> <s> </s> <0x41>", "▁ already", "tab\tand\r\nline", "x" * 3000, "long words and words " * 4000, "​﻿\u0000 odd",
]


def _docs(spark, texts=TEXTS):
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts)] + [(3, "another text of id three", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ---------------------------------------------------------------------------


def _plain_fim(key, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, z = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (n, "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}") if h4 % 100 < spm else (n, "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}")


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 50), (0, 0)])
def test_fim_equals_a_plain_version(spark, rate, spm):
    docs = _docs(spark)
    got = fim.fill_in_middle(docs, rate=rate, spm=spm, outputs=("n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256"))
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256"]  # form is replaced
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain_fim(r.doc_id, r.text, rate=rate, spm=spm)
        assert r.restored_sha256 == _sha(r.text or "") and fim.restore(r.output, r.form, fim.Sentinels()) == (r.text or "")
    if rate == 100:
        assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fim_sentinels_and_damaged_outputs(spark):
    with pytest.raises(ValueError):
        fim.Sentinels("<A>", "<A><B>", "<C>")
    with pytest.raises(ValueError):
        fim.Sentinels("aba", "<S>", "<M>")
    with pytest.raises(ValueError):
        fim.Sentinels("", "<S>", "<M>")
    with pytest.raises(ValueError):
        fim.restore("<P>no suffix<M>", "psm", fim.Sentinels())
    assert fim.fill_in_middle(_docs(spark).limit(0)).collect() == []
    other = fim.Sentinels("[pre]", "[suf]", "[mid]")
    for r in fim.fill_in_middle(_docs(spark), rate=100, sentinels=other).collect():
        assert fim.restore(r.output, r.form, other) == (r.text or "")


def test_units_are_those_of_the_pattern():
    rng = random.Random(5)
    for _ in range(500):
        t = "".join(rng.choice(" \t\n\x0b\x0c\rab é") for _ in range(rng.randint(0, 12)))
        ends = [0] + [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
        assert fim.unit_bounds(fim.codepoints(t)).tolist() == ends


# --- alignment ------------------------------------------------------------------------------------


def _plain_alignment(texts):
    """Of each text (a, b, groups, links), by two loops over byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    letters = {v: k for k, v in token_alignment.bpe.byte_letters().items()}
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = []
    for text in texts:
        data = (" " + (text or "")).encode()
        a, b = t.encode(" " + (text or ""), add_special_tokens=False).ids, s.encode(text or "")
        bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := s.id_to_piece(i)) else p.replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, x in enumerate(bytes_a):
            at += len(x)
            ends_a[at] = i
        at = 0
        for i, x in enumerate(bytes_b):
            at += len(x)
            ends_b[at] = i
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append((a[i : ends_a[e] + 1], b[j : ends_b[e] + 1]))
            links.append((a[ends_a[e]], b[ends_b[e]]))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        out.append((a, b, groups, links))
    return out


@pytest.mark.parametrize("broadcast_pairs", [1 << 20, 0])
def test_alignment_equals_a_plain_version(spark, broadcast_pairs):
    docs = _docs(spark).withColumnRenamed("form", "n_a")
    docs = docs.unionByName(spark.range(40).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("common words, and "), F.col("id")).alias("text"), F.lit("z").alias("n_a")))
    given = docs.collect()
    plain = _plain_alignment([r.text for r in given])
    counts = Counter(x for *_, links in plain for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for r, (a, b, groups, links) in zip(given, plain, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[r.doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), _sha(text) if text else ""] += 1
    got = token_alignment.aligned_documents(docs, TOKENIZER, PIECES, broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert sum(not x[1] for x in want) >= 3 and any(x[5] < x[4] for x in want)


def test_long_texts_are_cut_for_the_pieces_without_a_trace(monkeypatch):
    model = token_alignment.Aligner(TOKENIZER, PIECES)
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "▁", " ▁", "été", "<s>", "中"]) for _ in range(3000))
    whole = model.b.encode(text)
    monkeypatch.setattr(token_alignment, "CUT", 5)
    parts = model._parts(text)
    assert len(parts) > 50 and [i for p in parts for i in model.b.encode(p)] == whole


def test_both_encoders_of_a_agree():
    model = token_alignment.Aligner(TOKENIZER, PIECES)
    assert model.fast is not None
    rng = random.Random(4)
    tokens = [b.decode() for b in model.a.strings.values() if b.isascii()]
    for _ in range(2000):
        text = "".join(t[: rng.randint(1, len(t))] for t in rng.choices(tokens, k=rng.randint(1, 8)))
        assert model.fast.encode_ordinary(text) == np.frombuffer(model.a._plain(text), "<u4").tolist()
    wide = "a" + " " * 1_000_000 + "b"
    assert b"".join(model.a_bytes[i] for i in model._ids_of_a(wide)) == wide.encode()


def test_alignment_of_nothing(spark):
    assert token_alignment.aligned_documents(_docs(spark).limit(0), TOKENIZER, PIECES).collect() == []
    r = token_alignment.align_tokens(_docs(spark, ["tie tie"]).where("doc_id = 0"), TOKENIZER, PIECES).first()
    (a, b, groups, _), = _plain_alignment(["tie tie"])
    assert r.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) and (r.n_a, r.n_b) == (len(a), len(b))


# --- chats ----------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 1, "assistant", "<\\s> <\\\\/s>"), (2, 0, "system", "<<SYS>> <</SYS>>"), (None, 0, "user", "no id"), (None, None, None, "no turn"),
    (3, 0, "tool [/ROLE]", "[ROLE] x"), (3, 0, "tool [/ROLE]", "[ROLE] x"), (4, 5, "user", "y" * 5000), (-7, 0, "assistant", "[\\INST"),
]


def _plain_chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss))
    return out


@pytest.mark.parametrize("part_chars", [1 << 20, 30])
def test_chats_are_read_back(spark, part_chars):
    rows = CHATS + [(9, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(300)]  # one conversation over several ranges
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(5)
    parts = chat_format.format_chats(df, part_chars=part_chars)
    assert parts.where("conv_id = 9").count() > 1 and parts.where("conv_id = 9 and whole").count() == 0
    got = {r.conv_id: r for r in chat_format.chat_digests(df, part_chars=part_chars).collect()}
    want = _plain_chats(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    joined = {}
    for r in parts.orderBy("part").collect():
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.formatted
    assert {c: len(t) for c, t in joined.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert [t[:2] for t in TEMPLATE.parse(joined[2])] == [("system", "<<SYS>> <</SYS>>"), ("assistant", "<\\s> <\\\\/s>")]
    assert chat_format.chat_digests(df.limit(0)).collect() == []


def test_only_conflicting_texts_are_escaped():
    assert TEMPLATE.render("user", "plain \\ < [ text")[0] == "<s>[INST] plain \\ < [ text [/INST]</s>"
    rng = random.Random(1)
    pieces = [*TEMPLATE.controls, "\\", "<", "[", "/", "s>", "INST]", " ", "a", "<\\s>", "[\\\\/INST]", "<<", "SYS>>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
        assert TEMPLATE.unescape(TEMPLATE.escape(text)) == text
        role = rng.choice(["user", "assistant", "system", "", text])
        turn, start, end = TEMPLATE.render(role, text)
        assert [x[:2] for x in TEMPLATE.parse(turn + turn)] == [(role, text)] * 2
        assert TEMPLATE.unescape(turn[start:end]) == text and not TEMPLATE._bare.search(turn[start:end])


def test_the_grammar_refuses_other_texts():
    for bad in ("x", "<s>[INST] a", "<s>[INST] a [/ANS]</s>", "<s>[INST] <s> [/INST]</s>", "<s>[INST] a [/INST]</s>rest"):
        with pytest.raises(GrammarError):
            list(TEMPLATE.parse(bad))
    with pytest.raises(ValueError):
        ChatTemplate(controls=("\\x",))
    own = ChatTemplate(turns={"user": ("<u>", "</u>")}, other_role=("<o>", "<:>"), other_close="</u>", controls=("<u>", "</u>", "<o>", "<:>"))
    assert [x[:2] for x in own.parse(own.render("user", "a</u><u>")[0] + own.render("b<:>", "<")[0])] == [("user", "a</u><u>"), ("b<:>", "<")]
