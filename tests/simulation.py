"""One-request-at-a-time versions of the operators, to test the set forms against."""

from __future__ import annotations


def quota(grants, uses):
    """grants (id, user, g, at), uses (id, user, at) -> {use: (ok, balance, grant)}, {grant: left}."""
    events = sorted([(at, 0, gid, user, g) for gid, user, g, at in grants]
                    + [(at, 1, uid, user, None) for uid, user, at in uses])
    held, result = {}, {}
    for at, kind, ident, user, g in events:
        mine = held.setdefault(user, [])
        if kind == 0:
            mine.append([ident, g])
            continue
        usable = next((grant for grant in mine if grant[1] > 0), None)
        if usable:
            usable[1] -= 1
        result[ident] = (usable is not None, sum(n for _, n in mine), usable[0] if usable else None)
    return result, {ident: n for grants in held.values() for ident, n in grants}


def redeem(requests, codes, grants):
    """requests (id, user, code, at), codes {code: [id, total, used, status, expires]}, grants {(user, code_id)}."""
    state = {code: list(row) for code, row in codes.items()}
    held, verdicts = set(grants), {}
    for rid, user, code, at in sorted(requests, key=lambda r: (r[3], r[0])):
        row = state.get(code)
        if row is None:
            verdicts[rid] = "not_found"
        elif row[3] != "active":
            verdicts[rid] = "inactive"
        elif row[4] is not None and row[4] < at:
            verdicts[rid] = "expired"
        elif row[2] >= row[1]:
            verdicts[rid] = "exhausted"
        elif (user, row[0]) in held:
            verdicts[rid] = "duplicate"
        else:
            verdicts[rid] = "ok"
            held.add((user, row[0]))
            row[2] += 1
            if row[2] >= row[1]:
                row[3] = "used"
    return verdicts, {row[0]: (row[2], row[3]) for row in state.values()}


def edit(documents, edits):
    """documents {(resume, user): dict}, edits (id, resume, user, patch or None, key, at)."""
    state, verdicts = {owner: dict(doc) for owner, doc in documents.items()}, {}
    for rid, resume, user, patch, key, at in sorted(edits, key=lambda e: (e[5], e[0])):
        doc = state.get((resume, user))
        if patch is not None and not patch:
            verdicts[rid] = "empty_patch"
        elif doc is None:
            verdicts[rid] = "not_found"
        else:
            verdicts[rid] = "ok"
            if patch is not None:
                doc.update(patch)
            else:
                doc.pop(key, None)
    return state, verdicts
