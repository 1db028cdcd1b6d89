"""Roots of experiments: a folder with a configuration of named stores. Small documents, handled on the driver, on any
filesystem that an URI names."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

FOLDER, FORMAT = ".driftloom", 1
DEFAULT_STORE = "local"


def filesystem(uri: str):
    """(filesystem, path) of a folder; plain paths are local."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in uri:
        system, path = FileSystem.from_uri(uri)
        return system, path.rstrip("/")
    return LocalFileSystem(), uri.removeprefix("file:").rstrip("/")


def _exists(uri: str) -> bool:
    from pyarrow.fs import FileType

    system, path = filesystem(uri)
    return system.get_file_info(path or "/").type != FileType.NotFound


@dataclass
class Config:
    """Stores by name (folders; relative ones lie under the root) and the name of the default one."""

    stores: dict[str, str] = field(default_factory=lambda: {DEFAULT_STORE: f"{FOLDER}/store"})
    default: str = DEFAULT_STORE

    def put(self, name: str, folder: str) -> None:
        self.stores[name] = folder

    def remove(self, name: str) -> None:
        """The default may then name a store that is gone; using it is an error."""
        if name not in self.stores:
            raise KeyError(f"no store is called {name}")
        del self.stores[name]

    def set_default(self, name: str) -> None:
        if name not in self.stores:
            raise KeyError(f"no store is called {name}")
        self.default = name

    def folder(self, root: str, name: str | None = None) -> str:
        name = self.default if name is None else name
        if name not in self.stores:
            raise KeyError(f"no store is called {name}")
        at = self.stores[name]
        return at if at.startswith("/") or "://" in at else f"{root.rstrip('/')}/{at}"


def is_root(folder: str) -> bool:
    return _exists(f"{folder.rstrip('/')}/{FOLDER}")


def locate(path: str) -> str | None:
    """The nearest folder at or above a path that is a root, with a final ``/``; None if there is none."""
    at = path.rstrip("/")
    while at and not at.endswith(":/"):
        if is_root(at):
            return at + "/"
        at = at.rpartition("/")[0]
    return "/" if not at and path.startswith("/") and is_root("") else None


def artefact_for(path: str) -> tuple[str, str]:
    """(root, id) of a path; outside of any root it is an error."""
    root = locate(path)
    if root is None:
        raise ValueError(f"{path} lies in no experiment")
    return root, path.removeprefix(root)


def write_config(root: str, config: Config) -> None:
    system, path = filesystem(f"{root.rstrip('/')}/{FOLDER}")
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/config.json") as out:
        out.write(json.dumps({"format": FORMAT, "default": config.default, "stores": config.stores}, indent=2).encode())


def initialise(root: str) -> Config:
    """Makes a folder a root; an error if it is one."""
    if is_root(root):
        raise FileExistsError(f"{root} is a root already")
    config = Config()
    write_config(root, config)
    return config


def open_root(root: str) -> Config:
    """The root's configuration; a folder that is no root, or another format, is an error."""
    if not is_root(root):
        raise FileNotFoundError(f"{root} is no root")
    system, path = filesystem(f"{root.rstrip('/')}/{FOLDER}/config.json")
    with system.open_input_stream(path) as source:
        document = json.loads(source.read())
    if document.get("format") != FORMAT:
        raise ValueError(f"unsupported configuration format {document.get('format')}")
    return Config(dict(document["stores"]), document["default"])
