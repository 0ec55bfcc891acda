"""Reports as DataFrame transformations; none of them runs a job."""
