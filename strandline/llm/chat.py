"""Chat formatting on a prefix tree.

Each conversation is a path of turns; a turn's node is named by a running hash of all turns up to it, so equal
beginnings share nodes. Conversations are sorted by their paths, which is the tree's depth-first order: a
conversation then has to emit only what lies beyond the turns it shares with its predecessor. The order is cut
into trees of about ``tree_chars`` characters beyond their first conversation; a tree repeats the shared beginning that
it starts with, so any number of conversations with one first turn, or of equal conversations, spreads over many
trees and tasks. A tree is a sequence of segments, a row each: the turn as formatted text, its offset in the tree's
stream, the position id of its first character (what stands before it on its own path), the intervals of the stream
that its ancestors cover, which are what it may attend to beside itself, whether it is under the loss and where
its text lies within it, and the conversations that end there.

With a tokenizer a segment has all this in tokens too: ``ids``, emitted once whatever number of conversations share
them, and offset, position, loss and ancestors counted in them. The control strings are one id each, the
first two numbers beyond the vocabulary (``control_ids``); role, text and line feeds are encoded each by itself, without special tokens. So the
ids along a path are those of the conversation formatted alone.

The template is ``<|im_start|>role LF text<|im_end|> LF``. In roles and texts a backslash becomes two and
``<|`` becomes ``<\\|``, so no text can hold a control string and unescaping gives every text back; a line feed
in a role is escaped too.

Turns go by turn number, then role and text where numbers repeat. Null roles and texts are empty; null
turn numbers come first; rows with a null conversation id are one conversation of their own. Repeated rows are
turns each. A conversation is the unit: it must fit in a task, however long its texts and many its turns are. An empty
table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, materialise
from strandline.llm.encoders import encoder

START, END = "<|im_start|>", "<|im_end|>\n"
FRAME_CHARS = 1 << 21
_TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and from where to where in it the escaped text lies."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, roles, texts) of each conversation; a path has eight bytes for each turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = bounded_batches(conversations).select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def walk(frames):
        for pdf in frames:
            names = []
            for roles, texts in zip(pdf["roles"], pdf["texts"], strict=True):
                node, path = hashlib.sha256(), []
                for role, said in zip(roles, texts, strict=True):
                    for x in (role, said):
                        raw = x.encode("utf-8", "surrogatepass")
                        node.update(len(raw).to_bytes(8, "little") + raw)
                    path.append(node.digest()[:8])
                names.append(b"".join(path))
            yield pdf.assign(path=names)

    return whole.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")).mapInPandas(walk, "conv_id string, roles array<string>, texts array<string>, path binary")


SEGMENTS = "tree string, segment long, offset long, position long, formatted string, loss boolean, loss_from long, loss_to long, ancestors array<struct<first:long,last:long>>, parent long, ends array<string>, ids array<int>, id_offset long, id_position long, id_loss_from long, id_loss_to long, id_ancestors array<struct<first:long,last:long>>"


def control_ids(tokenizer_path: str) -> tuple[int, int]:
    """The ids of the two control strings of the template."""
    size = encoder(tokenizer_path).size
    return size, size + 1


def encode_turn(tokenizer_path: str, role: str, text: str) -> tuple[list[int], int, int]:
    """The ids of a formatted turn, and from where to where in them the escaped text lies."""
    enc, (start, end) = encoder(tokenizer_path), control_ids(tokenizer_path)
    head, body, tail = (np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([escape_role(role) + "\n", escape(text), "\n"]))
    return [start, *head, *body, end, *tail], 1 + len(head), 1 + len(head) + len(body)


def _spans(stack: list, size, offset) -> list[dict]:
    """The intervals that the segments of a path cover; neighbours make one."""
    spans: list[dict] = []
    for _, s in stack:
        if spans and spans[-1]["last"] == offset(s):
            spans[-1]["last"] += size(s)
        else:
            spans.append({"first": offset(s), "last": offset(s) + size(s)})
    return spans


def format_tree(conversations: DataFrame, tree_chars: int = 1 << 16, loss_role: str = "assistant", tokenizer_path: str | None = None) -> DataFrame:
    """The segments of all trees, as SEGMENTS: parent is the segment of the turn before, or -1; ends lists the
    conversations that end with this turn (null for a null id). Without a tokenizer the columns of ids are null."""
    written = materialise(paths(conversations), "paths")
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    ordered = written.withColumn("chars", chars).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def emit(frames):
        tree, used, ids_used, ended, base, stack, rows = None, 0, 0, 0, 0, [], []
        for pdf in frames:
            for conv, roles, texts, path in zip(pdf["conv_id"], pdf["roles"], pdf["texts"], pdf["path"], strict=True):
                if tree is None or used - base + ended >= tree_chars:
                    if rows:
                        yield _frame(rows)
                    tree, used, ids_used, ended, base, stack, rows = f"{path.hex()[:16]}-{conv}", 0, 0, 0, 0, [], []
                shared = 0
                while shared < len(stack) and path[8 * shared : 8 * shared + 8] == stack[shared][0]:
                    shared += 1
                del stack[shared:]
                for k in range(shared, len(roles)):
                    formatted, first, last = format_turn(roles[k], texts[k])
                    up = stack[-1][1] if stack else None
                    segment = {
                        "tree": tree, "segment": len(rows), "offset": used, "position": up["position"] + len(up["formatted"]) if up else 0, "formatted": formatted, "loss": roles[k] == loss_role,
                        "loss_from": first, "loss_to": last, "ancestors": _spans(stack, lambda s: len(s["formatted"]), lambda s: s["offset"]), "parent": up["segment"] if up else -1, "ends": [],
                        "ids": None, "id_offset": None, "id_position": None, "id_loss_from": None, "id_loss_to": None, "id_ancestors": None,
                    }
                    if tokenizer_path is not None:
                        ids, first, last = encode_turn(tokenizer_path, roles[k], texts[k])
                        spans = _spans(stack, lambda s: len(s["ids"]), lambda s: s["id_offset"])
                        segment |= {"ids": ids, "id_offset": ids_used, "id_position": up["id_position"] + len(up["ids"]) if up else 0, "id_loss_from": first, "id_loss_to": last, "id_ancestors": spans}
                        ids_used += len(ids)
                    rows.append(segment)
                    stack.append((path[8 * k : 8 * k + 8], segment))
                    used += len(formatted)
                base = base or used  # what the first conversation takes is there anyway
                stack[-1][1]["ends"].append(conv)
                ended += 1  # so that equal conversations close a tree some time
        if rows:
            yield _frame(rows)

    return ordered.drop("chars").mapInPandas(emit, SEGMENTS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    numbers = ["id_offset", "id_position", "id_loss_from", "id_loss_to"]
    return frame.astype(dict.fromkeys(numbers, "Int64"))


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted, losses) of each conversation from its tree: the whole formatted text, and the escaped
    text of each of its segments under the loss, in order."""
    trees = segments.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("segment", "formatted", "loss", "loss_from", "loss_to", "parent", "ends"))).alias("s"))

    def run(frames):
        for pdf in frames:
            out, held = [], 0
            for s in pdf["s"]:
                for last in s:
                    if len(last["ends"]):
                        path, at = [], last
                        while at is not None:
                            path.append(at)
                            at = s[int(at["parent"])] if at["parent"] >= 0 else None
                        path.reverse()
                        formatted = "".join(x["formatted"] for x in path)
                        losses = [x["formatted"][int(x["loss_from"]) : int(x["loss_to"])] for x in path if x["loss"]]
                        for conv in last["ends"]:
                            out.append((conv, formatted, losses))
                            held += len(formatted)
                            if held >= FRAME_CHARS:  # each conversation has its own copy of its whole path
                                yield pd.DataFrame(out, columns=["conv_id", "formatted", "losses"])
                                out, held = [], 0
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "losses"])

    return trees.select("s").mapInPandas(run, "conv_id string, formatted string, losses array<string>")


def digests(back: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted text."""

    def run(frames):
        for pdf in frames:
            out = []
            for formatted, losses in zip(pdf["formatted"], pdf["losses"], strict=True):
                turns = parse(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(map(unescape, losses))
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), sha(said), len(loss), sha(loss), len(formatted)))
            done = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([pdf[["conv_id"]].reset_index(drop=True), done], axis=1)

    return back.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast("long"))
