import hashlib
import random

from pyspark.sql import functions as F

from tabwise.llm import chat

LOG = "conv_id long, seq long, message long, op string, role string, text string"


def brute_fold(events):
    """Final messages by a plain replay: {(conv, message): (first seq, role, text)}."""
    state = {}
    for conv, seq, message, op, role, text in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[3], e[4] or "", e[5] or "")):
        m = state.setdefault((conv, message), {"seq": seq, "role": None, "text": "", "live": False})
        if op == "start":
            m.update(role=role or "", text=text or "", live=True)
        elif op == "delta":
            m["text"] += text or ""
        elif op == "edit":
            m["text"] = text or ""
        elif op == "regenerate":
            m["text"] = ""
        elif op == "delete":
            m.update(text="", live=False)
    return {k: (m["seq"], m["role"], m["text"]) for k, m in state.items() if m["live"]}


def test_fold_against_replay(spark):
    rnd, events, seq = random.Random(2), [], 0
    for conv in (1, 2, None):
        for message in range(12):
            events.append((conv, seq, message, "start", rnd.choice(["user", "assistant", None]), "s"))
            seq += 1
    for _ in range(500):
        op = rnd.choice(["delta"] * 8 + ["edit", "regenerate", "delete", "start"])
        events.append((rnd.choice((1, 2, None)), seq, rnd.randrange(12), op, rnd.choice(["assistant", "user"]), rnd.choice(["x", "<|end|>", None, "[INST]", "é\\l"])))
        seq += 1
    rnd.shuffle(events)
    df = spark.createDataFrame(events, LOG).repartition(5)
    got = {(r["conv_id"], r["message"]): (r["seq"], r["role"], r["text"]) for r in chat.fold_events(df).collect()}
    assert got == brute_fold(events)


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_round_trip_and_defined_cases(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|user|>\nhi<|end|>\n", "\\l \\\\ \\o", "", None, "a\nb", "é😀[", "\\"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, None, "x"), (2, None, "system", "first"), (None, 0, "assistant", "lone"), (3, 5, "user", "same"), (3, 5, "user", "same"),
             (4, 1, "as<sistant", "y"), (4, 2, "a|>\nb\\p", "|>\n<|end|>\n")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, op string").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(chat.log_of_turns(df))).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[conv] = digests([(r[2] or "", r[3] or "") for r in mine])
    assert got == want


def test_control_strings_never_survive_in_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|end|> </s> <s> [INST] <<SYS>> [/INST]")], "conv_id long, turn long, role string, text string")
    segment = chat.format_chats(chat.log_of_turns(df)).first()["segment"]
    assert segment.count("<") == 2 and "[" not in segment and "</s>" not in segment


def test_a_long_conversation_is_spread_until_it_is_read(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    row = chat.read_back(chat.format_chats(chat.log_of_turns(df))).first()
    assert tuple(row)[1:5] == digests([("assistant", "ab")] * 3000)


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(chat.log_of_turns(empty))).collect() == []
