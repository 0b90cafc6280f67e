"""Files of quantized networks: the binary layouts, C headers, and the float file of the chess engine."""

from __future__ import annotations

import struct

import numpy as np

from plyworks.operators.networks import QA, QB, Network
from plyworks.variants import Variant


def to_bytes(net: Network) -> bytes:
    """Magic by kernel, 16 bytes of name, width, features, buckets; W1, B1, W2 and, for chess, B2."""
    v = net.variant
    head = struct.pack("<4s16siii", b"NTW2" if v.chess else b"NTW1", v.name.encode().ljust(16, b"\0")[:16], net.h, v.n_features, net.buckets)
    body = net.w1.astype("<i2").tobytes() + net.b1.astype("<i4").tobytes() + net.w2.astype("<i2").tobytes()
    return head + body + (struct.pack("<i", net.b2) if v.chess else b"")


def _layouts(raw: bytes, v: Variant):
    """(offset of W1, width, features, buckets, has B2) that the file's magic allows."""
    magic = raw[:4]
    ints = lambda at, n: struct.unpack_from(f"<{n}i", raw, at)
    if magic in (b"NTW1", b"NTW2"):
        if len(raw) < 32:
            raise ValueError("short header")
        name = raw[4:20].split(b"\0")[0].decode("latin-1")
        if name != v.name:
            raise ValueError(f"the file holds variant {name!r}, not {v.name!r}")
        if (magic == b"NTW2") != v.chess:
            raise ValueError("the file is of the other kernel")
        return [(32, *ints(20, 3), v.chess)]
    if magic == b"DNN2":
        return ([(16, *ints(4, 3), False)] if len(raw) >= 16 else []) + [(8, *ints(4, 1), v.n_features, 1, False)]
    if magic == b"DNN1":
        return [(8, *ints(4, 1), v.n_features, 1, False)]
    raise ValueError(f"bad magic {magic!r}")


def from_bytes(raw: bytes, v: Variant) -> Network:
    """A network of any of the layouts. Of two that share a magic the one whose length is right is meant."""
    if len(raw) < 8:
        raise ValueError("short file")
    for at, h, n, buckets, has_b2 in _layouts(raw, v):
        if min(h, n, buckets) <= 0 or len(raw) != at + 2 * n * h + 4 * h + 2 * buckets * h + 4 * has_b2:
            continue
        if n != v.n_features:
            raise ValueError(f"{n} features, but {v.name} has {v.n_features}")
        w1 = np.frombuffer(raw, "<i2", n * h, at).reshape(n, h)
        b1 = np.frombuffer(raw, "<i4", h, at + 2 * n * h)
        w2 = np.frombuffer(raw, "<i2", buckets * h, at + 2 * n * h + 4 * h).reshape(buckets, h)
        return Network(v, w1.astype(np.int16), b1.astype(np.int32), w2.astype(np.int16), struct.unpack_from("<i", raw, len(raw) - 4)[0] if has_b2 else 0)
    raise ValueError(f"no layout of {v.name} is {len(raw)} bytes long")


def write(path: str, net: Network) -> None:
    with open(path, "wb") as f:
        f.write(to_bytes(net))


def read(path: str, v: Variant) -> Network:
    with open(path, "rb") as f:
        return from_bytes(f.read(), v)


def header(net: Network) -> str:
    """The C header of a quantized network, in its kernel's form."""
    return _chess_header(net) if net.variant.chess else _draughts_header(net)


def _draughts_header(net: Network) -> str:
    v = net.variant
    row = lambda x: ",".join(map(str, x.tolist()))
    rows = lambda x: "".join("{" + row(r) + "},\n" for r in x)
    out = ["/* Generated by plyworks; do not edit.", " * out = 64 * W2 . (clip(B1 + sum W1[f]) - clip(B1 + sum W1[mirror f])), weights times 256.", f" * {v.feature_doc}", f" * {v.name}: man {v.man}, king {v.king}"]
    if net.buckets > 1:
        out += [f" * {net.buckets} rows of W2 by piece count, from {', '.join(map(str, v.cuts))} pieces on"]
    out += [" */", f"#define NN_H {net.h}", f"#define NN_NUM_FEAT {v.n_features}"]
    out += [f"#define NN_W2_BUCKETS {net.buckets}"] if net.buckets > 1 else []
    text = "\n".join(out) + "\nstatic const int16_t NN_W1[NN_NUM_FEAT][NN_H] = {\n" + rows(net.w1) + "};\n"
    text += "static const int32_t NN_B1[NN_H] = {" + row(net.b1) + "};\n"
    if net.buckets == 1:
        return text + "static const int16_t NN_W2[NN_H] = {" + row(net.w2[0]) + "};\n"
    return text + "static const int16_t NN_W2[NN_W2_BUCKETS][NN_H] = {\n" + rows(net.w2) + "};\n"


def _chess_header(net: Network) -> str:
    if net.buckets != 1:
        raise ValueError("the chess kernel has a single row of output weights")
    v = net.variant

    def block(kind: str, name: str, x: np.ndarray) -> str:
        values = [f"{n}," for n in x.ravel().tolist()]
        lines = "".join("".join(values[i : i + 16]) + ("\n" if len(values) - i >= 16 else "") for i in range(0, len(values), 16))
        return f"static const {kind} {name}[{len(values)}] = {{\n{lines}\n}};\n\n"

    out = f"/* Generated by plyworks; do not edit. Residue on the classical evaluation, {v.n_features}->{net.h}->1, QA={QA} QB={QB}.\n * {v.feature_doc} */\n#ifndef NNUE_WEIGHTS_H\n#define NNUE_WEIGHTS_H\n#include <stdint.h>\n\n"
    out += block("int16_t", "nnue_w1", net.w1) + block("int32_t", "nnue_b1", net.b1) + block("int16_t", "nnue_w2", net.w2)
    return out + f"static const int32_t nnue_b2 = {net.b2};\n\n#endif /* NNUE_WEIGHTS_H */\n"


def net_bin(net: Network) -> bytes:
    """The float file of the chess engine: magic, features, width, 2 for a residue; W1, B1, W2, B2 in 32 bits."""
    if not net.variant.chess:
        raise ValueError("only chess has this format")
    body = b"".join(np.asarray(x, dtype="<f4").tobytes() for x in (net.w1, net.b1, net.w2, [net.b2]))
    return struct.pack("<4i", 0x4E4E5545, net.variant.n_features, net.h, 2) + body


def read_net_bin(raw: bytes, v: Variant) -> Network:
    magic, n, h, version = struct.unpack_from("<4i", raw)
    if magic != 0x4E4E5545 or version != 2 or n != v.n_features or len(raw) != 16 + 4 * (n * h + 2 * h + 1):
        raise ValueError("not a residue network of this variant")
    flat = np.frombuffer(raw, "<f4", offset=16).astype(np.float64)
    return Network(v, flat[: n * h].reshape(n, h), flat[n * h : n * h + h], flat[n * h + h : n * h + 2 * h].reshape(1, h), float(flat[-1]))
