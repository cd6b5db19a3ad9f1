"""Near duplicates of a larger table against a plain program: neither a document too many nor one too few is dropped."""

from collections import defaultdict

import numpy as np

from orrerix.llm import simhash_trie
from orrerix.llm.common import table

FOLDER, WORDS, SIMILARITY = "/root/testdata/sf0.1", 5, 0.8


def plain_kept(rows):
    """The smallest doc_id of each class: texts that share a rare shingle are compared by their sets."""
    ids = defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    texts, number = list(ids), {}
    sets = []
    for t in texts:
        ws = t.encode().lower().split()
        own = {b" ".join(ws[k : k + WORDS]) for k in range(max(1, len(ws) - WORDS + 1))} if ws else {None}
        sets.append(np.array(sorted(number.setdefault(s, len(number)) for s in own)))
    often, holders, up = np.bincount(np.concatenate(sets)), defaultdict(list), list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, own in enumerate(sets):
        rare = own[np.lexsort((own, often[own]))][: len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1].tolist()
        for j in {j for s in rare for j in holders[s]}:
            both = len(np.intersect1d(sets[j], own, assume_unique=True))
            if both >= SIMILARITY * (len(sets[j]) + len(own) - both) - 1e-9:
                a, b = sorted((root(j), root(k)))
                up[b] = a
        for s in rare:
            holders[s].append(k)
    least = {}
    for k, t in enumerate(texts):
        least[root(k)] = min([least.get(root(k), ids[t][0]), *ids[t]])
    return sorted(least.values())


def test_no_document_too_many_or_too_few(shared):
    docs = table(shared, FOLDER, "documents")
    want = plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = simhash_trie.representatives(docs, WORDS, SIMILARITY).select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == want and 0 < len(want) < docs.count()
