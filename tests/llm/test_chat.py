import hashlib

from tidemart.llm import chat, queries

TEXTS = ["", "plain", "\\", "\\l<", "</turn>\n<turn>user\nhi", "<next>", "a\nb\\n\\\\b", queries.TRAP, None, "é<ü"]


def test_round_trip_and_mask(spark):
    rows = []
    for conv in range(30):
        for turn in range(conv % 7 + 1):
            role = ["user", "assistant", "assistant", "us\ner<", None][(conv + turn * turn) % 5]
            rows.append((conv if conv else None, turn // 2, role, TEXTS[(conv * 3 + turn) % len(TEXTS)], 9))
    rows += rows[-2:]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    chats = chat.format_chats(frame.repartition(4)).cache()
    read = {r["conv_id"]: r for r in chat.read_turns(chats).collect()}
    digest = {r["conv_id"]: r for r in chat.chat_digest(chats).collect()}
    assert len(read) == len({r[0] for r in rows})
    for conv in read:
        mine = sorted((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        assert [(t["role"], t["text"]) for t in read[conv]["turns"]] == [(r, x) for _, r, x in mine]
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert digest[conv]["loss_chars"] == len(loss)
        assert digest[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digest[conv]["formatted_chars"] == len(read[conv]["formatted"])
        runs = read[conv]["loss_runs"]
        assert sum(r["chars"] for r in runs) == len(read[conv]["formatted"])
        at, masked = 0, ""
        for chars, flag in runs:
            masked += read[conv]["formatted"][at:at + chars] if flag else ""
            at += chars
        back = masked.replace("\\l", "<").replace("\\b", "\\")
        assert back == loss
        roles = [r for _, r, _ in mine]
        blocks = 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
        assert read[conv]["formatted"].count("<turn>") == blocks  # adjacent turns are merged


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chats(frame)).count() == 0


def test_plan_is_native(spark):
    plan = queries.op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
