"""Exports in archives, long lists and lines: every document, whatever the cuts."""

import io
import json
import random
import zipfile

import pytest

from threadloom.sources import exports, packed


def conversations(n, seed=3):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "漢", "\n", "a", "b", " "]) for _ in range(rng.randrange(60)))
    return [{"uuid": f"c{k}", "odd\\\"key": [[], {}], "chat_messages": [{"uuid": f"{k}-{j}", "sender": "human", "text": f"t{k}.{j} {text()}"} for j in range(rng.randrange(1, 5))]} for k in range(n)]


def wanted(docs):
    return sorted((c["uuid"], j, m["text"]) for c in docs for j, m in enumerate(c["chat_messages"]))


def got(df):
    return sorted((r.session_id, r.position, r.text) for r in exports.messages(df.where("state = 'ok'")).collect())


@pytest.mark.parametrize("slice_bytes", [97, 1000, 1 << 20])
@pytest.mark.parametrize("wrapped", [False, True])
def test_lists_by_slices(spark, tmp_path, slice_bytes, wrapped):
    docs = conversations(30)
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "list.json").write_text(json.dumps({"conversations": docs} if wrapped else docs, ensure_ascii=False, indent=1 if slice_bytes == 1000 else None))
    rows = packed.read(spark, f"file://{tmp_path}", slice_bytes)
    assert got(rows) == wanted(docs)


def test_lines_archives_and_others(spark, tmp_path):
    docs = conversations(40)
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(d) for d in docs[:8]) + "\n\n{broken")
    (tmp_path / "one.json").write_text(json.dumps(docs[9]))
    (tmp_path / "two.json").write_text(json.dumps(docs[10]) + "\n" + json.dumps(docs[8]))
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sub/conversations.json", json.dumps(docs[11:30]))
        z.writestr("one.json", json.dumps(docs[30]))
        z.writestr("more.ndjson", "\n".join(json.dumps(d) for d in docs[31:]))
        z.writestr("readme.txt", "no")
        z.writestr("empty/", "")
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG")
    rows = packed.read(spark, f"file://{tmp_path}", 300).cache()
    assert got(rows) == wanted(docs)
    assert sorted((r.path.split("/")[-1], r.state) for r in exports.unread(rows).collect()) == [("bad.zip", "invalid"), ("pic.png", "not_json"), ("x.jsonl", "invalid"), ("y.zip!readme.txt", "not_json")]
    rows.unpersist()


@pytest.mark.parametrize("shape", ["claude", "chatgpt"])
def test_long_documents_in_parts(spark, tmp_path, shape):
    text = lambda k: f"{k} " + "long [text], \\ \"quoted\" " * 40
    if shape == "claude":
        doc = {"uuid": "u", "name": "kept", "chat_messages": [{"uuid": str(k), "sender": "human", "text": text(k)} for k in range(50)], "tail": [1]}
    else:
        doc = {"conversation_id": "u", "title": "kept", "mapping": {f"n{(k * 7) % 50}": {"message": {"author": {"role": "user"}, "content": {"parts": [text((k * 7) % 50)]}, "create_time": (k * 7) % 50}} for k in range(50)}}
    for name, docs in (("single", doc), ("list", [doc])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "d.json").write_text(json.dumps(docs))
        rows = packed.read(spark, f"file://{folder}", 1 << 20, 5000)
        assert rows.count() > 5
        out = exports.messages(rows).orderBy("position").collect()
        assert [(r.position, r.text, r.title) for r in out] == [(k, text(k), "kept") for k in range(50)]


def test_tokens_over_chunks(monkeypatch):
    raw = json.dumps(conversations(5), ensure_ascii=False).encode()
    whole = list(packed.tokens(io.BytesIO(raw), 0))
    for size in (1, 7, 64):
        monkeypatch.setattr(packed, "CHUNK", size)
        assert list(packed.tokens(io.BytesIO(raw), 0)) == whole
    spans = list(packed.elements(io.BytesIO(raw), 0, 0, 1))
    assert [json.loads(raw[a:b]) for a, b in spans] == conversations(5)


def test_a_list_larger_than_any_cell(spark, tmp_path):
    """100 MB in one list: more than the JSON parser's longest text, and no document lost."""
    n, text = 400, "w" * 250_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",".join(json.dumps({"uuid": f"c{k}", "chat_messages": [{"uuid": "m", "sender": "human", "text": f"{k} {text}"}]}) for k in range(n)) + "]")
    rows = exports.messages(packed.read(spark, f"file://{tmp_path}", 8 << 20)).selectExpr("session_id", "length(text) AS n").collect()
    assert sorted(r.session_id for r in rows) == sorted(f"c{k}" for k in range(n)) and {r.n for r in rows} == {len(f"{k} {text}") for k in range(n)}
