"""Small graphs, written out by hand."""

from graphloom.sources.primitives import Store, frame

G = "00000012400034568%015x"


def guid(n):
    return G % n


def values(spark, *texts, names=None, first=0):
    """One node for each value (None: no value)."""
    rows = [{"id": first + i, "value": v, "name": names[i] if names else None} for i, v in enumerate(texts)]
    return Store(frame(spark, rows), {}, single=True)


class Graph:
    """Nodes and links in the order they are made."""

    def __init__(self):
        self.rows, self.types = [], {}

    def type(self, name):
        if name not in self.types:
            self.types[name] = len(self.rows)
            self.rows.append({"id": len(self.rows)})
        return self.types[name]

    def add(self, type_=None, **fields):
        t = self.type(type_) if type_ else None
        n = len(self.rows)
        self.rows.append({"id": n, "typeguid": t} | fields)
        return n

    def version(self, of, **fields):
        lineage = self.rows[of].get("lineage", of)
        n = self.add(prev=of, lineage=lineage, **fields)
        return n

    def store(self, spark):
        single = all("lineage" not in r for r in self.rows)
        return Store(frame(spark, self.rows), self.types, single)
