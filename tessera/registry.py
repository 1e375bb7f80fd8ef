"""Components by role: given explicitly, by the name of an entry point, the sole one installed, or built in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from importlib import metadata

from tessera.errors import ConflictError, ProtocolError, RegistryError
from tessera.operators import dense, parse
from tessera.operators.chunk import tokens
from tessera.operators.ranking import rrf
from tessera.sources.connectors import MemoryConnector

INTERFACE = 1
#: What a component of each role must have; an empty tuple means that it is called.
ROLES: dict[str, tuple[str, ...]] = {
    "connector": ("list_sources", "read"), "parser": (), "chunker": (), "embedder": ("embed", "dimension", "name"), "store": ("table", "stage", "promote"),
    "sparse_retriever": (), "dense_retriever": (), "fusion": (), "reranker": (), "generator": (), "token_counter": (), "observer": (),
    "query_planner": (), "evidence_grader": (), "corpus_router": (), "stop_condition": (), "tool": (), "session_store": (),
}
BUILT_IN: dict[str, Callable[[], object]] = {
    "connector": MemoryConnector, "parser": lambda: parse.parse_markdown, "token_counter": lambda: tokens, "fusion": lambda: rrf,
}


def installed(role: str) -> dict[str, list[Callable[[], object]]]:
    out: dict[str, list[Callable[[], object]]] = {}
    for point in metadata.entry_points(group=f"tessera.{role}"):
        out.setdefault(point.name, []).append(point.load)
    return out


def check(role: str, component: object, needs: tuple[str, ...] = ()) -> object:
    """The component, if it has its role's members, this interface version and the capabilities asked for."""
    missing = [m for m in ROLES[role] if not hasattr(component, m)]
    if missing or (not ROLES[role] and not callable(component)):
        raise ProtocolError(f"not a {role}: it lacks {', '.join(missing) or 'a call'}")
    if getattr(component, "interface_version", INTERFACE) != INTERFACE:
        raise ProtocolError(f"{role} of interface version {component.interface_version}; this is {INTERFACE}")
    if lacking := set(needs) - set(getattr(component, "capabilities", ())):
        raise ProtocolError(f"{role} lacks {', '.join(sorted(lacking))}")
    return component


def resolve(role: str, explicit: object | None = None, name: str | None = None, needs: tuple[str, ...] = (), points: Mapping[str, list[Callable[[], object]]] | None = None) -> object:
    if role not in ROLES:
        raise RegistryError(f"unknown role {role!r}")
    if explicit is not None:
        return check(role, explicit, needs)
    points = installed(role) if points is None else points
    if name is not None:
        found = points.get(name, [])
        if len(found) > 1:
            raise ConflictError(f"several {role}s are named {name!r}")
        if not found:
            raise RegistryError(f"no {role} is named {name!r}; there are: {', '.join(sorted(points)) or 'none'}")
        return check(role, found[0](), needs)
    every = [p for ps in points.values() for p in ps]
    if len(every) > 1:
        raise ConflictError(f"several {role}s are installed, name one: {', '.join(sorted(points))}")
    if every:
        return check(role, every[0](), needs)
    if role in BUILT_IN:
        return check(role, BUILT_IN[role](), needs)
    raise RegistryError(f"no {role} is given or installed")


__all__ = ["BUILT_IN", "INTERFACE", "ROLES", "check", "dense", "installed", "resolve"]
