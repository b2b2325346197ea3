"""Registries of named primitives."""


class Registry:
    def __init__(self, what):
        self.what, self.items = what, {}

    def register(self, name, item):
        if not isinstance(name, str) or not name:
            raise ValueError(f"a {self.what} needs a name")
        if not callable(item):
            raise TypeError(f"{self.what} {name!r} isn't callable")
        self.items[name] = item
        return item

    def get(self, name):
        if name not in self.items:
            raise KeyError(f"unknown {self.what}: {name}")
        return self.items[name]

    def names(self):
        return sorted(self.items)


AGGREGATIONS = Registry("aggregation")
TRANSFORMATIONS = Registry("transformation")


def register_aggregation(name, item, inputs=("numeric",), output="numeric", **options):
    """Registers an Aggregation, or a function from a Column (of doubles for numbers) to an aggregate Column as one.

    The function gets the values that are known at the date and lie in the interval, all others as null. ``inputs`` are the types of
    columns that it takes, ``output`` the type of its result ("same": the column's own), ``options`` are those of Aggregation.
    """
    if callable(item) and not hasattr(item, "applies"):
        from .aggregations import Aggregation

        item = Aggregation(name, tuple(inputs), lambda s, f=item: f(s.when(s.x)), output=output, **options)
    return AGGREGATIONS.register(name, item)


def register_transformer(name, item, inputs=("numeric",), output="numeric", **options):
    """Registers a Transformation, or a function from a Column to a Column as one.

    With ``windowed=True`` the function also gets the Rows of the entity, whose windows (order(), last(n), population) it may use.
    """
    if callable(item) and not hasattr(item, "applies"):
        from .transformations import Transformation

        build = item if options.get("windowed") else lambda x, rows, f=item: f(x)
        item = Transformation(name, tuple(inputs), build, output=output, **options)
    return TRANSFORMATIONS.register(name, item)


def get_aggregations(names=None):
    return {n: AGGREGATIONS.get(n) for n in (AGGREGATIONS.names() if names is None else names)}


def get_transformers(names=None):
    return {n: TRANSFORMATIONS.get(n) for n in (TRANSFORMATIONS.names() if names is None else names)}
