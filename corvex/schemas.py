"""Explicit schemas of what is kept on storage."""

REPOSITORY = (
    "struct<provider:string,owner:string,name:string,full_name:string,clone_url:string,ssh_url:string,default_branch:string,"
    "description:string,language:string,size_kb:bigint,last_updated:timestamp,is_private:boolean,topics:array<string>>"
)
INDEX_INFO = f"name string, path string, repository {REPOSITORY}, created_at timestamp, updated_at timestamp, file_count bigint, size_bytes bigint"
WORKSPACE_INFO = f"name string, path string, repositories array<{REPOSITORY}>, created_at timestamp, updated_at timestamp"
INDEX_METADATA = "version int, num_vectors bigint, dimension int, created_at bigint, updated_at bigint, description string"
