from tokenweave.operators.order import token_offsets
from tokenweave.plans.corpora import ORDER


def streams(tokens):
    """The token stream of each split, laid out by the offsets."""
    out = {}
    for r in token_offsets(tokens, ORDER).orderBy("start").collect():
        ids = out.setdefault(r.split, [])
        assert r.start == len(ids) and r.n == len(r.ids)
        ids.extend(r.ids)
    return out
