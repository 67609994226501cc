from dutymark.llm.chat import Template, format_chats, read_chats

TURNS = "conv_id long, turn long, role string, text string, state string"


def test_round_trip_and_loss(spark):
    said = ["</s>[INST] ok [/INST]", "\\s\\\\[x]\\l<s>", "", None, "é<<SYS>> \\"]
    rows = [(1, i, r, said[i % 5], "x") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(2, 0, "tool]<", "a[b]", None), (2, 1, None, "c", None), (2, None, "user", "first", None), (None, 0, "user", "q", None), (None, 1, "assistant", "a", None)]
    rows += [(3, 0, "user", "same", None), (3, 0, "user", "same", None), (4, 0, "assistant", "x" * 100_000, None)]
    out = {r["conv_id"]: r for r in read_chats(format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t or "") for _, _, r, t, _ in rows[:5]]
    assert out[1]["loss_text"] == "" + "é<<SYS>> \\" and out[1]["valid"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("user", "first"), ("tool]<", "a[b]"), ("", "c")] and not out[2]["valid"]
    assert out[None]["valid"] and out[None]["loss_text"] == "a"
    assert len(out[3]["turns"]) == 2 and out[3]["state"] == "invalid"
    assert out[4]["loss_text"] == "x" * 100_000 and not out[4]["valid"]


def test_machine(spark):
    cases = {"ua": True, "sua": True, "uaua": True, "u": False, "au": False, "uua": False, "usa": False, "us": False, "s": False, "sa": False}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(k, i, names[c], "t", None) for k, turns in enumerate(cases) for i, c in enumerate(turns)]
    out = {r["conv_id"]: r["valid"] for r in format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert [out[k] for k in range(len(cases))] == list(cases.values())


def test_segments_make_the_text(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "a", None)]
    r = format_chats(spark.createDataFrame(rows, TURNS)).first()
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"] == "<s>[INST] q [/INST]</s><s>[OUT] a [/OUT]</s>"
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["a"]
    assert Template().roles["assistant"].loss


def test_empty_table(spark):
    assert read_chats(format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_ties_are_ordered_by_the_text_itself(spark):
    texts = ["Z", "<a", "[b", "\\c", "a", ""]
    rows = [(1, 0, "user", t) for t in texts]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first()
    coded = lambda t: t.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\s").replace("]", "\\e")
    assert [x["text"] for x in out["segments"]][2::5] == [coded(t) for t in sorted(texts)]
