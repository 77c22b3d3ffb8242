"""Fixed schemas of the catalogue, lineage and mapping documents."""

ROW_FILTER = "struct<handler:string,args:map<string,string>>"

GOVERNANCE = (
    f"struct<rowFilters:array<{ROW_FILTER}>,row_filters:array<{ROW_FILTER}>,"
    "userFilterColumn:string,user_filter_column:string,consentRequired:boolean,medallion:string,"
    "title:string,description:string,accessLevel:string,accessRights:string,classification:string,"
    "license:string,owners:array<string>,tags:array<string>,attribution:string,retentionDays:bigint,"
    "sourceSystem:string>"
)

LINEAGE = (
    "struct<namespace:string,name:string,sourceName:string,createdAt:string,updatedAt:string,"
    f"lastLifecycleState:string,tags:array<string>,facets:struct<governance:{GOVERNANCE}>>"
)

TAGS = (
    "struct<keywords:array<string>,themes:array<string>,accrualPeriodicity:string,accessRights:string,"
    "temporal:struct<start:string,end:string>,contactPoint:struct<fn:string,email:string>,"
    "identifier:string,conformsTo:string>"
)

BACKEND = (
    "struct<table:string,path:string,format:string,public_url:string,size_bytes:bigint,base_url:string,"
    "fiware_service:string,fiware_service_path:string,entity_type:string>"
)

_FIELD = "source:string,target:string,kind:string,datatype:string,required:boolean,value:string"
# Fields below the first nested level stay JSON text; mapping.mapped_columns follows them to any depth.
NESTED = f"array<struct<{_FIELD},nested_fields:string>>"
FLAT_FIELD = f"struct<{_FIELD}>"
FIELD = f"struct<{_FIELD},nested_fields:{NESTED}>"

MAPPING = (
    "struct<version:string,target_type:string,id_template:string,"
    f"profile:struct<name:string,version:string>,fields:array<{FIELD}>>"
)

CATALOGUE = (
    "dataset_id string, title string, description string, backend_type string, "
    f"backend_config {BACKEND}, ontology_path string, ontology_mapping {MAPPING}, "
    "schema_override_path string, expose boolean, dataspace_expose boolean, "
    f"tags {TAGS}, publisher_uri string, rights_holder_uri string, license_uri string, "
    "landing_page string, language_uris array<string>, spatial_uris array<string>, "
    f"lineage {LINEAGE}, access_level string"
)

LINEAGE_RECORD = (
    "namespace string, name string, physicalName string, sourceName string, createdAt string, "
    "updatedAt string, lastModifiedAt string, lastLifecycleState string, description string, "
    "tags array<string>, facets map<string,string>"
)
