"""Readers and writers of images, labels, reports and manifests."""
