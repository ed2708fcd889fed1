"""Table schemas and inputs."""
