"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def ascii_lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def components(n, links):
    low = list(range(n))

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def simhash(docs):
    """{doc_id: (fingerprint, component_id)}"""
    docs = sorted(docs)
    fps = []
    for _, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
        sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    comp = components(len(docs), links)
    return {d: (f"{fps[i]:016x}", docs[comp[i]][0]) for i, (d, _) in enumerate(docs)}


def decontaminate(docs, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    where = {}
    for item, text in items:
        ws = word.findall(ascii_lower(text or ""))
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            where.setdefault(tuple(ws[i : i + size]), set()).add(str(item))
    lengths = {len(k) for k in where}
    out = {}
    for doc, text in docs:
        ws = word.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                own = where.get(tuple(ws[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[doc] = (len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def substrings(docs, size=13):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - size + 1):
            if first[tuple(ws[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def embeddings(rows, least=0.98):
    """{vec_id: (n_links, component_id, kept)}"""
    rows = sorted(rows, key=lambda r: r[0])
    ok = [lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = []
    by = {}
    for i, (_, v, lab) in enumerate(rows):
        if ok[i]:
            by.setdefault((lab, len(v)), []).append(i)
    for own in by.values():
        m = np.array([rows[i][1] for i in own], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)
        close = (m @ m.T) / norm[:, None] / norm[None, :] >= least
        links += [(own[a], own[b]) for a, b in zip(*np.nonzero(close)) if a < b]
    comp = components(len(rows), links)
    n = np.bincount([x for e in links for x in e], minlength=len(rows)) if links else np.zeros(len(rows), int)
    return {r[0]: (int(n[i]), rows[comp[i]][0], comp[i] == i) for i, r in enumerate(rows)}


def chat(turns):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    by = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0], t[1])):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        out[conv] = (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
    return out


def packing_ok(docs, pieces, encode, end_id=1, max_length=2048):
    """pieces: dicts; checks ids, cover, powers of two and unique sequences."""
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    assert len(by) == len(docs)
    for doc, text in docs:
        ids = np.array(encode(text or "") + [end_id], dtype="<u4")
        at = 0
        for p in sorted(by[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["offset"] == 0 and p["doc_tokens"] == len(ids)
            assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= max_length
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
