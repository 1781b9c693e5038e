"""Plain-Python models of the ordered merge and the closure, for comparison on small lists."""


def ordered_slots(keys):
    """``keys``: list of (seq, site or None, name or None) in seq order -> {seq: slot}."""
    by_site, by_name, slots = {}, {}, {}
    for seq, site, name in keys:
        slot = by_site.get(site) if site else None
        if slot is None and name:
            slot = by_name.get(name)
        if slot is None:
            slot = seq
        slots[seq] = slot
        if name:
            by_name[name] = slot
        if site:
            by_site[site] = slot
    return slots


def closure(keys):
    parent = {seq: seq for seq, _, _ in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for seq, site, name in keys:
        for key in (("s", site), ("n", name)):
            if key[1]:
                other = seen.setdefault(key, seq)
                a, b = sorted((find(other), find(seq)))
                parent[b] = a
    return {seq: find(seq) for seq, _, _ in keys}
