import datetime as dt

import pytest

from veedor.runtime import get_session
from veedor.schema import CONTRACT_SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "veedor-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return None if text is None else dt.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """Contracts from partial rows; dates as ISO text."""

    def build(*rows):
        base = {
            "id_contrato": "C1", "nombre_entidad": "Alcaldía", "nit_entidad": "N1", "proveedor": "Prov",
            "doc_proveedor": "D1", "modalidad": "Licitación pública", "tipo_contrato": "Obra",
            "departamento": "Bolívar", "ciudad": "Cartagena", "fecha_firma": "2024-01-01",
            "fecha_inicio": "2024-01-10", "fecha_fin": "2024-02-10", "valor_raw": "$ 1,000",
            "objeto_raw": "x" * 40,
        }
        full = []
        for i, row in enumerate(rows):
            merged = {**base, "id_contrato": f"C{i:04d}", **row}
            for c in ("fecha_firma", "fecha_inicio", "fecha_fin"):
                merged[c] = day(merged[c])
            full.append(tuple(merged[c] for c in CONTRACT_SCHEMA.names))
        return spark.createDataFrame(full, CONTRACT_SCHEMA)

    return build
