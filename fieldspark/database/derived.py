"""Derived results: what each needs, on which shapes, and how it follows as Columns.

Those of one tensor or vector are expressions on the row that holds it, so they cost no join; rates and displacements are
windows over the states of one entity; those of an element's nodes gather them once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import kernels as K

STRESS, STRAIN = K.STRESS, K.STRAIN


@dataclass(frozen=True)
class Derived:
    name: str
    title: str
    needs: tuple[str, ...]
    #: What gives it: "row" (of the values of ``needs``), "states" or "mesh".
    how: str
    compute: Callable[..., Column] | None = None
    #: The class that carries ``needs``, where it is not the result's own.
    on: str | None = None
    instead: tuple[str, ...] = ()
    shapes: tuple[str, ...] = ()


def _registry() -> dict[str, Derived]:
    out: list[Derived] = []
    axes = "xyz"
    position = tuple(f"u{a}" for a in axes)
    out += [Derived(f"disp_{a}", f"{a.upper()} Displacement", (f"u{a}",), "states") for a in axes]
    out += [Derived("disp_mag", "Displacement Magnitude", position, "states"), Derived("disp_rad_mag_xy", "Radial (XY) Displacement Magnitude", position[:2], "states")]
    out += [Derived(f"{n}_{a}", f"{a.upper()} {t}", (f"u{a}",), "states") for n, t in (("vel", "Velocity"), ("acc", "Acceleration")) for a in axes]
    out.append(Derived("vol_strain", "Volumetric Strain", STRAIN[:3], "row", lambda x, y, z: x + y + z))
    for what, names in (("strain", STRAIN), ("stress", STRESS)):
        kinds = [("prin", "", K.principal, "Principal"), ("prin_dev", "", K.principal_deviatoric, "Principal Deviatoric")]
        if what == "strain":
            kinds += [("prin", "_alt", K.principal_alternate, "Principal"), ("prin_dev", "_alt", lambda *s: K.principal_alternate(*s, deviatoric=True), "Principal Deviatoric")]
        for head, tail, f, title in kinds:
            for i in range(3):
                out.append(Derived(f"{head}_{what}{i + 1}{tail}", f"{title} {what.title()} {i + 1}", names, "row", lambda *s, f=f, i=i: f(*s)[i]))
    out += [
        Derived("eff_stress", "Effective (von Mises) Stress", STRESS, "row", K.effective),
        Derived("pressure", "Pressure", STRESS[:3], "row", K.pressure),
        Derived("max_shear_stress", "Maximum Shear Stress", STRESS, "row", K.max_shear),
        Derived("triaxiality", "Triaxiality", STRESS, "row", K.triaxiality),
        Derived("norm_press", "Normalized Pressure", STRESS, "row", K.normalized_pressure),
        Derived("eps_rate", "Effective Plastic Strain Rate", ("eps",), "states"),
        Derived("nodtangmag", "Nodal Tangential Traction Magnitude", tuple(f"nodtang_{a}" for a in axes), "row", K.magnitude),
    ]
    out += [Derived(f"mat_cog_disp_{a}", f"Material Center of Gravity {a.upper()} Displacement", (f"matcg{a}",), "states") for a in axes]
    mesh = {"on": "node"}
    out += [
        Derived("element_volume", "Element Volume", ("nodpos",), "mesh", shapes=("HEX", "TET"), **mesh),
        Derived("area", "Element Area", ("nodpos",), "mesh", shapes=("QUAD",), **mesh),
        Derived("centroid", "Element Centroid", ("nodpos",), "mesh", **mesh),
    ]
    out += [Derived(f"surfstrain{p}", f"Surface Strain {p.upper()}", position, "mesh", shapes=("HEX",), **mesh) for p in ("x", "y", "z", "xy", "yz", "zx")]
    out.append(Derived("relative_volume", "Relative Volume", ("nodpos",), "mesh", shapes=("HEX", "TET"), **mesh))
    out.append(Derived("normal_force", "Normal Force", ("sn",), "mesh", instead=("nodpres",), shapes=("QUAD",)))
    out += [Derived(f"force_{a}", f"{a.upper()} Force", (f"s{i + 1}",), "mesh", shapes=("QUAD",)) for i, a in enumerate(axes)]
    out.append(Derived("shear_magnitude", "Shear Magnitude", ("qxx", "qyy"), "row", K.magnitude))
    return {d.name: d for d in out}


REGISTRY = _registry()


def register(derived: Derived) -> None:
    """Add a result of one's own; a name is taken once."""
    if derived.name in REGISTRY:
        raise ValueError(f"{derived.name} is registered")
    REGISTRY[derived.name] = derived


def _there(db, names: tuple[str, ...], where: str) -> bool:
    return all(n in db.variable_of and where in db.carriers(n) for n in names)


def of_class(db, name: str) -> list[str]:
    """Results that a class can have: all they need is carried (something else instead will do), and the shape fits."""
    if name not in db.class_of:
        return []
    shape = db.superclass(name)
    return [d.name for d in REGISTRY.values() if (not d.shapes or shape in d.shapes) and (_there(db, d.needs, d.on or name) or d.instead and _there(db, d.instead, d.on or name))]


def classes_of(db, name: str) -> list[str]:
    """Classes that can have a result, by what it needs and by shape; what would do instead does not count."""
    from ..functions.errors import UnknownName

    if name not in REGISTRY:
        raise UnknownName(f"no derived result {name}")
    d = REGISTRY[name]
    return [c.name for c in db.classes if (not d.shapes or c.superclass in d.shapes) and _there(db, d.needs, d.on or c.name)]
