"""Names and types of the contract table."""

from pyspark.sql import types as T

# Header of the CSV export -> canonical name.
EXPORT_COLUMNS = {
    "ID Contrato": "id_contrato",
    "Nombre Entidad": "nombre_entidad",
    "Nit Entidad": "nit_entidad",
    "Proveedor Adjudicado": "proveedor",
    "Documento Proveedor": "doc_proveedor",
    "Modalidad de Contratacion": "modalidad",
    "Tipo de Contrato": "tipo_contrato",
    "Departamento": "departamento",
    "Ciudad": "ciudad",
    "Fecha de Firma": "fecha_firma",
    "Fecha de Inicio del Contrato": "fecha_inicio",
    "Fecha de Fin del Contrato": "fecha_fin",
    "Valor del Contrato": "valor_raw",
    "Objeto del Contrato": "objeto_raw",
}

# Field of the open-data API -> canonical name.
API_COLUMNS = {
    "id_contrato": "id_contrato",
    "nombre_entidad": "nombre_entidad",
    "nit_entidad": "nit_entidad",
    "proveedor_adjudicado": "proveedor",
    "documento_proveedor": "doc_proveedor",
    "modalidad_de_contratacion": "modalidad",
    "tipo_de_contrato": "tipo_contrato",
    "departamento": "departamento",
    "ciudad": "ciudad",
    "fecha_de_firma": "fecha_firma",
    "fecha_de_inicio_del_contrato": "fecha_inicio",
    "fecha_de_fin_del_contrato": "fecha_fin",
    "valor_del_contrato": "valor_raw",
    "objeto_del_contrato": "objeto_raw",
}

DATE_COLUMNS = ("fecha_firma", "fecha_inicio", "fecha_fin")

# Contract dates are wall-clock values without a zone, so they stay TIMESTAMP_NTZ:
# results do not depend on the session time zone.
CONTRACT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.TimestampNTZType() if name in DATE_COLUMNS else T.StringType())
        for name in EXPORT_COLUMNS.values()
    ]
)

FLAG_COLUMNS = (
    "flag_fin_antes_inicio",
    "flag_firma_despues_inicio",
    "flag_valor_invalido",
    "flag_objeto_muy_corto",
    "flag_duracion_negativa",
)

ENRICHED_COLUMNS = (
    "id_contrato",
    "nombre_entidad",
    "nit_entidad",
    "proveedor",
    "doc_proveedor",
    "modalidad",
    "tipo_contrato",
    "departamento",
    "ciudad",
    "fecha_firma",
    "fecha_inicio",
    "fecha_fin",
    "valor_num",
    "longitud_objeto",
    "duracion_dias",
    *FLAG_COLUMNS,
)

PAIR_KEYS = ("nit_entidad", "nombre_entidad", "doc_proveedor", "proveedor")
