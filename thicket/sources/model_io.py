"""Models as files: open JSON, binary JSON (UBJSON), node tables, text and DOT."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
from pyspark.sql import SparkSession

from ..operators.booster import Booster
from ..operators.tree import Node, Tree
from ..plans.params import Params

#: The parent of a root in the open format (fixed value).
NO_PARENT = 2147483647


def to_document(model: Booster) -> dict:
    """The open model document; numbers of the parameter records are strings there."""
    c = model.params
    trees = []
    for t, tree in enumerate(model.trees):
        n = tree.nodes
        parents = [NO_PARENT] * len(n)
        for k, x in enumerate(n):
            if not x.is_leaf:
                parents[x.left] = parents[x.right] = k
        leaf = [c.eta * tree.weight * x.value for x in n]
        cats = [(k, x.cat_left) for k, x in enumerate(n) if x.cat_left is not None]
        trees.append({
            "base_weights": leaf, "default_left": [int(x.default_left) for x in n], "left_children": [x.left for x in n], "right_children": [x.right for x in n], "parents": parents,
            "split_indices": [max(x.feature, 0) for x in n], "split_conditions": [leaf[k] if x.is_leaf else x.threshold for k, x in enumerate(n)],
            "split_type": [int(x.cat_left is not None) for x in n], "loss_changes": [x.gain for x in n], "sum_hessian": [x.h for x in n],
            "categories": [int(v) for _, own in cats for v in own], "categories_nodes": [k for k, _ in cats], "categories_segments": np.cumsum([0, *[len(own) for _, own in cats]])[: len(cats)].tolist(), "categories_sizes": [len(own) for _, own in cats],
            "id": t, "tree_param": {"num_deleted": "0", "num_feature": str(len(model.features)), "num_nodes": str(len(n)), "size_leaf_vector": "1"},
        })
    base = 1 / (1 + math.exp(-model.base)) if c.objective in ("binary:logistic", "binary:logitraw", "reg:logistic") else model.base
    return {
        "version": [3, 2, 0],
        "learner": {
            "attributes": {"eta": repr(c.eta), "base_margin": repr(float(model.base))}, "feature_names": list(model.features), "feature_types": [],
            "learner_model_param": {"base_score": f"[{base:.9E}]", "boost_from_average": str(int(c.boost_from_average)), "num_class": str(c.classes if c.classes > 1 else 0), "num_feature": str(len(model.features)), "num_target": "1"},
            "gradient_booster": {"name": "gbtree", "model": {
                "gbtree_model_param": {"num_parallel_tree": str(c.num_parallel_tree), "num_trees": str(len(trees))}, "trees": trees, "tree_info": [t.class_idx for t in model.trees],
                "iteration_indptr": list(range(0, len(trees) + 1, max(1, c.classes * c.num_parallel_tree))), "cats": {},
            }},
            "objective": {"name": c.objective, "reg_loss_param": {"scale_pos_weight": repr(c.scale_pos_weight)}},
        },
    }


def _threshold(cut: float, inclusive: bool) -> float:
    """A threshold for "below goes left" over doubles.

    Inclusive files send equal values left. Others compare float32 values: a double
    rounds to a float32 below the cut if it is under the middle of that gap.
    """
    if inclusive:
        return float(np.nextafter(cut, math.inf))
    t = np.float32(cut)
    return (float(np.nextafter(t, np.float32(-np.inf))) + float(t)) / 2


def from_document(doc: dict, inclusive: bool | None = None) -> Booster:
    """A model from the open document, or from the older list-of-nodes form.

    Leaf values are taken from the split conditions (where leaves keep them) or, if
    these are 0, from the base weights. ``inclusive`` says that a value equal to the
    threshold goes left; by default only files that carry that mark do.
    """
    if "learner" not in doc:
        return _from_nodes_document(doc, True if inclusive is None else inclusive)
    learner = doc["learner"]
    attributes, mp = learner.get("attributes") or {}, learner["learner_model_param"]
    mark = next((k for k in attributes if k.endswith("learning_rate")), None)
    if inclusive is None:
        inclusive = mark is not None
    exact = "base_margin" in attributes  # written by to_document
    objective = learner["objective"]["name"]
    classes = int(mp.get("num_class") or 0)
    gb = learner["gradient_booster"]
    gb = gb.get("gbtree", gb)
    c = Params().with_(objective=objective, num_class=max(1, classes), eta=1.0, num_parallel_tree=max(1, int(gb["model"]["gbtree_model_param"].get("num_parallel_tree", 1))))
    features = tuple(learner.get("feature_names") or ()) or tuple(f"f{i}" for i in range(int(mp["num_feature"])))
    trees = []
    for t, info in zip(gb["model"]["trees"], gb["model"]["tree_info"], strict=True):
        sets = {}
        for k, at, n in zip(t.get("categories_nodes") or [], t.get("categories_segments") or [], t.get("categories_sizes") or [], strict=False):
            sets[k] = [float(v) for v in t["categories"][at : at + n]]
        nodes = []
        for k, left in enumerate(t["left_children"]):
            if left < 0:
                value = float(t["split_conditions"][k]) or float(t["base_weights"][k])
                nodes.append(Node(value=value, h=float(t["sum_hessian"][k])))
            else:
                cut = float(t["split_conditions"][k])
                nodes.append(Node(feature=int(t["split_indices"][k]), threshold=cut if exact else _threshold(cut, inclusive), cat_left=sets.get(k), left=left, right=t["right_children"][k], default_left=bool(t["default_left"][k]), gain=float(t["loss_changes"][k]), h=float(t["sum_hessian"][k])))
        for n in nodes:
            if not n.is_leaf:
                nodes[n.left].depth = nodes[n.right].depth = n.depth + 1
        trees.append(Tree(nodes, info))
    base = float(str(mp["base_score"]).strip("[]"))
    if "base_margin" in attributes:
        base = float(attributes["base_margin"])
    elif objective in ("binary:logistic", "binary:logitraw", "reg:logistic"):
        base = math.log(base / (1 - base)) if 0 < base < 1 else 0.0
    return Booster(c, features, trees, base)


def _from_nodes_document(doc: dict, inclusive: bool) -> Booster:
    """The older form: flat configuration and a list of node records for each tree."""
    pick = lambda *names, default=None: next((doc[n] for n in names if n in doc), default)
    eta = float(pick("learning_rate", "eta", default=1.0))
    c = Params().with_(objective=pick("objective", default="reg:squarederror"), eta=eta)
    trees, width = [], 0
    for t in doc["trees"]:
        nodes = []
        for r in sorted(t["nodes"], key=lambda r: r["id"]):
            leaf = r.get("left", -1) < 0
            cut = float(r.get("threshold", 0.0))
            nodes.append(Node(feature=-1 if leaf else r["feature"], threshold=_threshold(cut, inclusive), left=-1 if leaf else r["left"], right=-1 if leaf else r["right"], value=float(r.get("leaf_value", 0.0)), gain=float(r.get("gain", 0.0)), g=float(r.get("sum_grad", 0.0)), h=float(r.get("sum_hess", 0.0))))
            width = max(width, nodes[-1].feature + 1)
        trees.append(Tree(nodes))
    return Booster(c, tuple(f"f{i}" for i in range(width)), trees, float(pick("base_score", default=0.0)))


def save_json(model: Booster, path: str) -> None:
    with open(path, "w") as f:
        json.dump(to_document(model), f)


def load_json(path: str, inclusive: bool | None = None) -> Booster:
    with open(path) as f:
        return from_document(json.load(f), inclusive)


def save_ubjson(model: Booster, path: str) -> None:
    with open(path, "wb") as f:
        f.write(ubjson_encode(to_document(model)))


def load_ubjson(path: str, inclusive: bool | None = None) -> Booster:
    with open(path, "rb") as f:
        return from_document(ubjson_decode(f.read()), inclusive)


def save_nodes(model: Booster, spark: SparkSession, path: str) -> None:
    """The node table as Parquet, for reading by any engine."""
    model.nodes(spark).write.mode("overwrite").parquet(path)


# ---- UBJSON, draft 12: one-byte markers, big-endian numbers ----

_INTS = [("i", ">b", -(2**7), 2**7 - 1), ("U", ">B", 0, 2**8 - 1), ("I", ">h", -(2**15), 2**15 - 1), ("l", ">i", -(2**31), 2**31 - 1), ("L", ">q", -(2**63), 2**63 - 1)]
_SIZES = {"i": ">b", "U": ">B", "I": ">h", "l": ">i", "L": ">q", "d": ">f", "D": ">d"}


def _int(n: int) -> bytes:
    for mark, form, low, high in _INTS:
        if low <= n <= high:
            return mark.encode() + struct.pack(form, n)
    raise OverflowError(n)


def _text(s: str) -> bytes:
    raw = s.encode()
    return _int(len(raw)) + raw


def ubjson_encode(x: object) -> bytes:
    if x is None:
        return b"Z"
    if isinstance(x, bool):
        return b"T" if x else b"F"
    if isinstance(x, int):
        return _int(x)
    if isinstance(x, float):
        return b"D" + struct.pack(">d", x)
    if isinstance(x, str):
        return b"S" + _text(x)
    if isinstance(x, dict):
        return b"{" + b"".join(_text(k) + ubjson_encode(v) for k, v in x.items()) + b"}"
    if x and all(isinstance(v, float) for v in x):  # strongly typed
        return b"[$D#" + _int(len(x)) + struct.pack(f">{len(x)}d", *x)
    return b"[" + b"".join(map(ubjson_encode, x)) + b"]"


def ubjson_decode(data: bytes) -> object:
    value, end = _decode(data, 0)
    if end != len(data):
        raise ValueError("bytes after the document")
    return value


def _number(data: bytes, at: int, mark: str) -> tuple[float, int]:
    form = _SIZES[mark]
    n = struct.calcsize(form)
    return struct.unpack(form, data[at : at + n])[0], at + n


def _string(data: bytes, at: int) -> tuple[str, int]:
    n, at = _number(data, at + 1, chr(data[at]))
    return data[at : at + n].decode(), at + n


def _decode(data: bytes, at: int, mark: str | None = None) -> tuple[object, int]:
    if mark is None:
        mark, at = chr(data[at]), at + 1
        if mark == "N":
            return _decode(data, at)
    if mark in "ZTF":
        return {"Z": None, "T": True, "F": False}[mark], at
    if mark in _SIZES:
        return _number(data, at, mark)
    if mark == "S":
        return _string(data, at)
    if mark == "C":
        return chr(data[at]), at + 1
    if mark not in "[{":
        raise ValueError(f"unknown marker {mark!r}")
    kind = count = None
    if data[at : at + 1] == b"$":
        kind, at = chr(data[at + 1]), at + 2
    if data[at : at + 1] == b"#":
        count, at = _number(data, at + 2, chr(data[at + 1]))
    out: list | dict = [] if mark == "[" else {}
    close = b"]" if mark == "[" else b"}"
    while len(out) < count if count is not None else data[at : at + 1] != close:
        key = None
        if mark == "{":
            key, at = _string(data, at)
        value, at = _decode(data, at, kind)
        if mark == "[":
            out.append(value)
        else:
            out[key] = value
    return out, at if count is not None else at + 1


# ---- dumps ----


def dump_text(model: Booster, names: tuple[str, ...] | None = None, stats: bool = True) -> str:
    """``booster[i]:`` blocks, one line a node, children indented by a tab."""
    names = names or tuple(f"f{i}" for i in range(len(model.features)))
    out = []
    for t, tree in enumerate(model.trees):
        out.append(f"booster[{t}]:")

        def line(k: int, depth: int, tree: Tree = tree) -> None:
            n, pad = tree.nodes[k], "\t" * depth
            if n.is_leaf:
                out.append(f"{pad}{k}:leaf={n.value:.9g}" + (f",cover={n.h:.9g}" if stats else ""))
                return
            test = f"{names[n.feature]} in {{{','.join(f'{v:g}' for v in n.cat_left)}}}" if n.cat_left is not None else f"{names[n.feature]}<{n.threshold:.9g}"
            miss = n.left if n.default_left else n.right
            out.append(f"{pad}{k}:[{test}] yes={n.left},no={n.right},missing={miss}" + (f",gain={n.gain:.9g},cover={n.h:.9g}" if stats else ""))
            line(n.left, depth + 1)
            line(n.right, depth + 1)

        line(0, 0)
    return "\n".join(out) + "\n"


def dump_dot(model: Booster, names: tuple[str, ...] | None = None) -> str:
    """One cluster for each tree; node names are unique over all trees."""
    names = names or tuple(f"f{i}" for i in range(len(model.features)))
    out = ["digraph model {"]
    for t, tree in enumerate(model.trees):
        out.append(f'  subgraph cluster_{t} {{ label="tree {t}";')
        for k, n in enumerate(tree.nodes):
            me = f"t{t}_n{k}"
            if n.is_leaf:
                out.append(f'    {me} [shape=box, label="leaf={n.value:.6g}"];')
                continue
            out.append(f'    {me} [label="{names[n.feature]} < {n.threshold:.6g}"];')
            for child, yes in ((n.left, True), (n.right, False)):
                mark = "yes" if yes else "no"
                out.append(f'    {me} -> t{t}_n{child} [label="{mark}{", missing" if n.default_left == yes else ""}"];')
        out.append("  }")
    return "\n".join([*out, "}"]) + "\n"


def plot_curve(history: list[dict], metric: str, width: int = 60, height: int = 12) -> str:
    """A learning curve in characters; empty for an unknown metric."""
    values = [h[metric] for h in history if metric in h]
    if not values:
        return ""
    low, high = min(values), max(values)
    cells = [[" "] * width for _ in range(height)]
    for i, v in enumerate(values):
        x = i * (width - 1) // max(1, len(values) - 1)
        y = round((v - low) / (high - low) * (height - 1)) if high > low else 0
        cells[height - 1 - y][x] = "*"
    rows = [f"{high - (high - low) * r / max(1, height - 1):10.4f} |{''.join(c)}" for r, c in enumerate(cells)]
    return "\n".join([metric, *rows, " " * 11 + "+" + "-" * width, " " * 12 + f"0{str(len(values) - 1).rjust(width - 1)}"]) + "\n"


def plot_importance(ranking: list[tuple[str, float]], most: int = 10) -> str:
    """Bars of up to 40 characters, the longest for the largest score."""
    own = sorted(ranking, key=lambda r: -r[1])[:most]
    top = max([s for _, s in own], default=0.0)
    wide = max([len(n) for n, _ in own], default=0)
    return "".join(f"{n.ljust(wide)} |{'#' * (round(40 * s / top) if top > 0 else 0)} {s:.4f}\n" for n, s in own)
