"""Penalised regression splines whose penalty is chosen by generalised cross-validation.

The unpenalised fit leaves the moments X'WX, X'Wz and z'Wz of its last step.  From these alone
follow, for every penalty, the coefficients, the effective parameters and the squared error of
the working response, so all penalties are compared without another look at the data; the
chosen one is then fitted to convergence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from exposa.models import cells as CL


@dataclass
class Smooth:
    fit: CL.Fit
    penalty: float
    table: list[tuple[float, float, float]]       # (penalty, effective parameters, GCV) tried


def gcv(a: np.ndarray, rhs: np.ndarray, zz: float, rows: int, penalised: np.ndarray,
        penalties: Sequence[float]) -> list[tuple[float, float, float]]:
    """(penalty, effective parameters, rows * error / (rows - parameters)**2) of each penalty."""
    out = []
    for penalty in penalties:
        inverse = np.linalg.pinv(a + penalty * np.diag(penalised), rcond=1e-13, hermitian=True)
        b, used = inverse @ rhs, float(np.trace(inverse @ a))
        error = max(zz - 2 * b @ rhs + b @ a @ b, 0.0)
        out.append((float(penalty), used, float(rows * error / max(rows - used, 1e-9) ** 2)))
    return out


def fit_smooth(cells: CL.Cells, family: str, penalised: Sequence[str], steps: int = 49) -> Smooth:
    """Spline in the cells' numeric regressors; ``penalised`` names those whose coefficients shrink."""
    free = CL.fit(cells, [CL.Spec("free", family)])["free"]
    shrink = np.array([float(n in penalised) for n in free.names])
    size = max(float(np.diag(free.information) @ shrink) / max(shrink.sum(), 1.0), 1e-300)
    table = gcv(free.information, free.rhs, free.zz, free.rows, shrink, size * np.logspace(-8, 4, steps))
    best = min(table, key=lambda r: (r[2], -r[0]))[0]
    final = CL.fit(cells, [CL.Spec("smooth", family, penalty=tuple((best * shrink).tolist()))])["smooth"]
    return Smooth(final, best, table)
