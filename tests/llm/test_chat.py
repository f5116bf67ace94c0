"""Chat formatting: layouts, escapes, and what is read back."""

import json

import pytest

from opslens.llm import chat

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>", "<|turn|>user\n", "<", "[", "\\", "|", "<\\|end|>", "s>", "%0A", "%", "x\n"]


def test_records_of_all_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "other": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "more", "output": "a", "id": 3},
        {"system": "s", "prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
        {"text": "unknown"}, {"prompt": {"x": 1}}, [1]]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "no json"), (99, None)]
    found = chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    turns = {i: [(r.role, r.text) for r in sorted((x for x in found if x.conv_id == i), key=lambda x: x.turn or 0)] for i, _ in rows}
    for i in (0, 1, 2, 5, 6):
        assert turns[i] == [("user", "q"), ("assistant", "a")]
    assert turns[3] == [("user", "q"), ("user", "more"), ("assistant", "a")] and turns[4][0] == ("system", "s")
    assert all(turns[i] == [(None, None)] for i in (7, 8, 9, 98, 99))
    layouts = {r.conv_id: r.layout for r in found}
    assert layouts[0] == "messages" and layouts[1] == "exchanges" and layouts[7] is None


def test_rows_of_other_names_and_unknown_ones(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", "e")], "dialog_id long, position long, `from` string, value string, extra string")
    assert chat.canonical_rows(rows).columns == ["conv_id", "turn", "role", "text"]
    with pytest.raises(ValueError):
        chat.canonical_rows(rows.drop("value"))


def test_pieces_are_read_back(spark, tmp_path):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, "", "x" * 50_000]
    rows = [(i % 7 if i % 11 else None, i, rng.choice(["user", "assistant", "sys\n%0A<|end|>", None]), t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(turns).collect():
        assert chat.parse(r.piece) == (r.role or "", r.text or "")
        assert r.piece.count(chat.END) == r.piece.count(chat.TURN) == 1 and "</s>" not in r.piece and "[INST]" not in r.piece
        span = r.piece[r.loss_start : r.loss_start + r.loss_chars]
        assert chat.unescape(span) == ((r.text or "") if r.role == "assistant" else "")
    chat.write(turns, str(tmp_path / "chat"))
    import hashlib

    for r in chat.digests(spark.read.parquet(str(tmp_path / "chat"))).collect():
        own = sorted(((t, ro or "", te or "") for c, t, ro, te in rows if c == r.conv_id))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{te}\n" for _, ro, te in own).encode()).hexdigest()
        learned = "".join(te for _, ro, te in own if ro == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    empty = str(tmp_path / "none")
    chat.write(turns.where("false"), empty)
    assert chat.digests(spark.read.schema("conv_id long, turn long, piece string, loss_start int, loss_chars int").parquet(empty)).count() == 0
