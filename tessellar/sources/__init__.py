"""Source captures: working trees, revisions and project manifests."""
