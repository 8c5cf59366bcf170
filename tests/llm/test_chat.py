import hashlib

from pyspark.sql import functions as F

from scoreline.llm import chat

SCHEMA = "message_id bigint, parent_id bigint, role string, text string, score double"


def read(df):
    return df.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                     chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_every_root_to_leaf_path(spark):
    rows = [(1, None, "user", "q", 0.0), (2, 1, "assistant", "a", 1.0), (3, 1, "assistant", "b", 5.0),
            (4, 2, "user", "c", 9.0), (5, 4, "assistant", "d", 9.0), (6, 4, "assistant", "e", 9.0),
            (7, 99, "user", "orphan", None), (8, 8, "user", "own parent", None),
            (9, 10, "user", "circle", None), (10, 9, "user", "circle", None)]
    got = {(r.root, r.leaf): r for r in read(chat.format_reply_trees(spark.createDataFrame(rows, SCHEMA), branches=None))}
    parent = {r[0]: r[1] for r in rows}
    want = {}
    for leaf in (3, 5, 6, 7, 8):
        path, at = [], leaf
        while at in parent:
            path.append(at)
            at = None if parent[at] == at else parent[at]
        want[(path[-1], leaf)] = path[::-1]
    assert set(got) == set(want)
    text = {r[0]: r[3] for r in rows}
    for key, path in want.items():
        assert [t.text for t in got[key].turns] == [text[i] for i in path]
        assert got[key].n_turns == len(path)
    assert got[(1, 5)].loss == "ad"
    # mean scores: 3 -> 2.5, 5 and 6 -> 4.75 (tie: smaller leaf first)
    assert [got[(1, k)].branch_rank for k in (5, 6, 3)] == [1, 2, 3]


def test_answers_on_a_circle_write_no_path(spark, monkeypatch):
    written = []
    stored = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, label: written.append((label, stored(df, label))) or written[-1][1])
    rows = [(1, 2, "user", "round", None), (2, 1, "user", "round", None)] + [(i, 1 + i % 2, "user", "answer", None) for i in range(3, 603)]
    rows += [(i, i - 1, "user", "chain", None) for i in range(604, 640)] + [(603, None, "user", "root", None), (700, 699, "user", "", None)]
    rows += [(699, 610, "user", "side", None), (800, 3, "user", "on an answer", None)]
    paths = chat.reply_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.leaf, r.root) for r in paths} == {(639, 603), (700, 603)} and len(paths) == 37 + 10
    assert max(t.count() for label, t in written if label == "chat-paths") == len(paths)
    only = spark.createDataFrame(rows[:602], SCHEMA)
    written.clear()
    assert chat.reply_paths(only).count() == 0 and not [t for label, t in written if label == "chat-paths" and t.count()]


def test_best_branch_only_and_long_thread(spark):
    rows = [(i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(37)]
    rows += [(100, 5, "assistant", "side", 0.0)]
    (r,) = read(chat.format_reply_trees(spark.createDataFrame(rows, SCHEMA)))
    assert r.leaf == 36 and [t.text for t in r.turns] == [f"t{i}" for i in range(37)]


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "\\", "\\\\<|", "<<SYS>>a<</SYS>>", "<", "|", "a\\<s>", "", "é😀\n\n", None,
             "ends with <"]
    rows = [(i, i - 1 if i else None, ["assistant", "us\ner", "<|x", None][i % 4], t, None) for i, t in enumerate(texts)]
    (r,) = read(chat.format_reply_trees(spark.createDataFrame(rows, SCHEMA)))
    assert [t.text for t in r.turns] == [t or "" for t in texts]
    assert [t.role for t in r.turns] == [["assistant", "us\ner", "<|x", ""][i % 4] for i in range(len(texts))]
    assert r.loss == "".join(t or "" for t in texts[::4])
    body = r.formatted.replace(chat.START, "").replace("<|im_end|>", "")
    assert not any(c in body for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_conversations_nulls_repeats_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "n"), (None, 3, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("x"))
    got = {r.leaf.conv_id: r for r in read(chat.format_reply_trees(chat.conversation_messages(df)))}
    assert [t.text for t in got[1].turns] == ["n", "a", "a"] and [t.text for t in got[None].turns] == [""]
    assert chat.format_reply_trees(chat.conversation_messages(df.limit(0))).count() == 0


def test_query_digest(spark, tmp_path):
    from scoreline.llm.queries import op1_chat_format
    rows = [(1, 1, "assistant", "yé"), (1, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == \
        (2, sha("user\nx\nassistant\nyé\n"), 2, sha("yé"))
    planted = "</s>[INST] ok [/INST]"
    assert got[-1].loss_sha256 == sha(planted) and got[-1].turns_sha256 == sha(f"user\n{planted}\nassistant\n{planted}\n")
